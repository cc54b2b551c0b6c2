"""Vendor packs: service accounts plus custom rules that run after the built-in ones."""

from __future__ import annotations

from cfgveil.rules import RulePack, custom_rules

# The accounts, patterns and replacements of each vendor.
VENDOR_SETTINGS = {
    "cisco": {
        "service_accounts": (
            "admin", "cisco", "enable", "operator", "monitor", "rancid", "netconf", "restconf",
        ),
        "patterns": {
            "enable_secret": {"pattern": r"enable secret \d+ (\S+)",
                              "replacement": "enable secret 5 $REDACTED_ENABLE_SECRET",
                              "literals": ["enable secret "]},
            "username_secret": {"pattern": r"username (\S+) .*secret \d+ (\S+)",
                                "replacement": r"username \1 secret 5 $REDACTED_SECRET",
                                "literals": ["username "]},
            "tacacs_key": {"pattern": r"tacacs.*key \d+ (\S+)",
                           "replacement": "key 7 REDACTED_TACACS_KEY",
                           "literals": ["tacacs"]},
            "radius_key": {"pattern": r"radius.*key \d+ (\S+)",
                           "replacement": "key 7 REDACTED_RADIUS_KEY",
                           "literals": ["radius"]},
            "ospf_auth": {"pattern": r"message-digest-key \d+ md5 \d+ (\S+)",
                          "replacement": "message-digest-key 1 md5 7 REDACTED_OSPF_KEY",
                          "literals": ["message-digest-key "]},
            "bgp_password": {"pattern": r"neighbor (\S+) password \d+ (\S+)",
                             "replacement": r"neighbor \1 password 7 REDACTED_BGP_PASS",
                             "literals": ["neighbor "]},
            "snmp_community": {"pattern": r"snmp-server community (\S+)",
                               "replacement": "snmp-server community REDACTED_COMMUNITY",
                               "literals": ["snmp-server community "]},
        },
    },
    "paloalto": {
        "service_accounts": ("admin", "panorama", "api", "monitor", "operator"),
        "patterns": {
            "phash": {"pattern": r"<phash>[^<]+</phash>",
                      "replacement": "<phash>$REDACTED_HASH</phash>",
                      "literals": ["<phash>"]},
            "private_key": {"pattern": r"<private-key>[^<]+</private-key>",
                            "replacement": "<private-key>REDACTED_PRIVATE_KEY</private-key>",
                            "literals": ["<private-key>"]},
            "api_key": {"pattern": r"<api-key>[^<]+</api-key>",
                        "replacement": "<api-key>REDACTED_API_KEY</api-key>",
                        "literals": ["<api-key>"]},
            "shared_key": {"pattern": r"<key>[^<]+</key>",
                           "replacement": "<key>REDACTED_KEY</key>",
                           "literals": ["<key>"]},
        },
    },
    "juniper": {
        "service_accounts": ("root", "admin", "operator", "read-only", "super-user"),
        "patterns": {
            "encrypted_password": {"pattern": r'encrypted-password "([^"]+)"',
                                   "replacement": 'encrypted-password "$REDACTED_PASSWORD"',
                                   "literals": ['encrypted-password "']},
            "authentication_key": {"pattern": r'authentication-key "([^"]+)"',
                                   "replacement": 'authentication-key "$REDACTED_AUTH_KEY"',
                                   "literals": ['authentication-key "']},
            "preshared_key": {"pattern": r'pre-shared-key (ascii-text|hexadecimal) "([^"]+)"',
                              "replacement": r'pre-shared-key \1 "$REDACTED_PSK"',
                              "literals": ["pre-shared-key "]},
        },
    },
    "arista": {
        "service_accounts": ("admin", "cvpadmin", "ansible", "arista"),
        "patterns": {
            "username_secret": {"pattern": r"username (\S+) secret (sha512 )?\S+",
                                "replacement": r"username \1 secret sha512 $REDACTED_SECRET",
                                "literals": ["username "]},
            "enable_password": {"pattern": r"enable password (sha512 )?\S+",
                                "replacement": "enable password sha512 $REDACTED_ENABLE",
                                "literals": ["enable password "]},
            "tacacs_key": {"pattern": r"key \d+ (\S+)",
                           "replacement": "key 7 REDACTED_KEY",
                           "literals": ["key "]},
        },
    },
}

VENDOR_PACKS = {
    vendor: RulePack(vendor, custom_rules(s["patterns"]), tuple(s["service_accounts"]))
    for vendor, s in VENDOR_SETTINGS.items()
}


def vendor_pack(vendor: str) -> RulePack:
    """The pack of a vendor, looked up in any case; an unknown vendor is an error."""
    try:
        return VENDOR_PACKS[vendor.lower()]
    except KeyError:
        known = ", ".join(VENDOR_PACKS)
        raise ValueError(f"Unknown vendor: {vendor.lower()}. Available: {known}") from None
