"""Rule packs as data."""

from cfgveil.packs.builtin import BUILTIN
from cfgveil.packs.library import LIBRARY
from cfgveil.packs.samples import SAMPLE_BASIC, SAMPLE_CISCO, SAMPLE_README
from cfgveil.packs.strict import STRICT
from cfgveil.packs.vendors import VENDOR_PACKS, vendor_pack

__all__ = [
    "BUILTIN",
    "LIBRARY",
    "SAMPLE_BASIC",
    "SAMPLE_CISCO",
    "SAMPLE_README",
    "STRICT",
    "VENDOR_PACKS",
    "vendor_pack",
]
