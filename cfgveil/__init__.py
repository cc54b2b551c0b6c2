"""Find, count and remove secrets in large collections of configuration text, on Spark."""

from cfgveil.packs import BUILTIN, LIBRARY, STRICT, VENDOR_PACKS, vendor_pack
from cfgveil.rules import Rule, RulePack, custom_rules, library_rules

__all__ = [
    "BUILTIN",
    "LIBRARY",
    "STRICT",
    "VENDOR_PACKS",
    "Rule",
    "RulePack",
    "custom_rules",
    "library_rules",
    "vendor_pack",
]
