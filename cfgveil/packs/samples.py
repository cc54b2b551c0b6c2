"""Sample user packs: what a user's own rule file holds, as Python data."""

from __future__ import annotations

from cfgveil.rules import RulePack, custom_rules

# Accounts and rules of the sample packs.
SAMPLE_BASIC = RulePack(
    "sample_basic",
    custom_rules({
        "custom_api_key": {"pattern": r"X-API-Key: ([A-Za-z0-9+/=]+)",
                           "replacement": "X-API-Key: REDACTED_API_KEY",
                           "description": "Custom API key in headers",
                           "literals": ["X-API-Key: "]},
        "internal_subnet": {"pattern": r"192\.168\.\d+\.\d+",
                            "replacement": "192.168.X.X",
                            "description": "Internal subnet addresses",
                            "literals": ["192.168."]},
    }),
    service_accounts=("admin", "service", "monitor", "backup", "ansible", "netconf"),
    personal_accounts=("john.doe", "jane.smith", "bob.wilson", "alice.johnson"),
)

SAMPLE_CISCO = RulePack(
    "sample_cisco",
    custom_rules({
        "vtp_password": {"pattern": r"vtp password (\S+)",
                         "replacement": "vtp password REDACTED_VTP",
                         "description": "VTP domain password",
                         "literals": ["vtp password "]},
        "hsrp_auth": {"pattern": r"standby \d+ authentication md5 key-string (\S+)",
                      "replacement": "standby authentication md5 key-string REDACTED_HSRP",
                      "description": "HSRP authentication",
                      "literals": ["standby "]},
        "glbp_auth": {"pattern": r"glbp \d+ authentication md5 key-string (\S+)",
                      "replacement": "glbp authentication md5 key-string REDACTED_GLBP",
                      "description": "GLBP authentication",
                      "literals": ["glbp "]},
        "vrrp_auth": {"pattern": r"vrrp \d+ authentication (\S+)",
                      "replacement": "vrrp authentication REDACTED_VRRP",
                      "description": "VRRP authentication",
                      "literals": ["vrrp "]},
        "isis_password": {"pattern": r"isis password (\S+)",
                          "replacement": "isis password REDACTED_ISIS",
                          "flags": ["IGNORECASE"],
                          "description": "IS-IS routing protocol password",
                          "literals": ["isis password "]},
        "rip_auth": {"pattern": r"ip rip authentication key-chain (\S+)",
                     "replacement": "ip rip authentication key-chain REDACTED_RIP",
                     "description": "RIP authentication key-chain",
                     "literals": ["ip rip authentication key-chain "]},
        "dot1x_credentials": {"pattern": r"dot1x credentials (\S+)",
                              "replacement": "dot1x credentials REDACTED_DOT1X",
                              "description": "802.1X credentials",
                              "literals": ["dot1x credentials "]},
        "wireless_psk": {"pattern": r"wpa-psk ascii \d+ (\S+)",
                         "replacement": "wpa-psk ascii 7 REDACTED_WPA_PSK",
                         "description": "Wireless WPA pre-shared key",
                         "literals": ["wpa-psk ascii "]},
        "aaa_server_key": {"pattern": r"server-private (\S+) key (\S+)",
                           "replacement": r"server-private \1 key REDACTED_AAA_KEY",
                           "description": "AAA server private key",
                           "literals": ["server-private "]},
        "ipsec_password": {"pattern": r"crypto isakmp key (\S+) address",
                           "replacement": "crypto isakmp key REDACTED_IPSEC address",
                           "description": "IPSec ISAKMP key",
                           "literals": ["crypto isakmp key "]},
        "eigrp_auth": {"pattern": r"ip authentication key-chain eigrp \d+ (\S+)",
                       "replacement": "ip authentication key-chain eigrp REDACTED_EIGRP",
                       "description": "EIGRP authentication key-chain",
                       "literals": ["ip authentication key-chain eigrp "]},
        "ntp_auth_key": {"pattern": r"ntp authentication-key \d+ md5 (\S+)",
                         "replacement": "ntp authentication-key md5 REDACTED_NTP",
                         "description": "NTP authentication key",
                         "literals": ["ntp authentication-key "]},
        "archive_password": {"pattern": r"password \d+ (\S+)",
                             "replacement": "password 7 REDACTED_ARCHIVE",
                             "description": "Archive/backup password",
                             "literals": ["password "]},
    }),
    service_accounts=(
        "admin", "cisco", "enable", "operator", "monitor", "rancid", "netconf", "restconf", "ansible", "nornir",
    ),
    personal_accounts=("john.doe", "jane.smith", "network.admin", "tier1.support", "tier2.support"),
)

SAMPLE_README = RulePack(
    "sample_readme",
    custom_rules({
        "custom_secret": {"pattern": r"my-secret-pattern (\S+)",
                          "replacement": "REDACTED_SECRET",
                          "literals": ["my-secret-pattern "]},
        "api_key": {"pattern": r"api[_-]key[\s=:]+([\w\-]+)",
                    "replacement": "API_KEY_REDACTED",
                    "flags": ["IGNORECASE"],
                    "literals": ["api_key", "api-key"]},
        "internal_ip": {"pattern": r"10\.0\.0\.\d+",
                        "replacement": "10.0.0.XXX",
                        "literals": ["10.0.0."]},
    }),
)
