"""The repaired sanitize pack.

Same targets as the built-in pack, but specific rules run before general ones, type
digits are optional, no rule reaches over a line end, line passwords are covered, and
every rule maps its own output to itself, so a second pass changes nothing.
"""

from __future__ import annotations

from cfgveil.rules import Rule, RulePack

I = ("IGNORECASE",)  # noqa: E741
M = ("MULTILINE",)


def _server_rules(service: str) -> tuple[Rule, Rule]:
    label, token = f"{service.upper()} keys", f"<removed-{service}-key>"
    return (
        Rule(f"{service}_server_key", rf"({service}-server (?:[^\n]* )?key )(?:\d+ )?(\S+)", rf"\1{token}", I,
             label=label, literals=(f"{service}-server ",)),
        Rule(f"{service}_server_block",
             rf"({service} server [^\n]+(?:\n[ \t]+(?!key \S)[^\n]+)*?\n[ \t]+key )(?:\d+ )?(\S+)", rf"\1{token}", I,
             label=label, literals=(f"{service} server ",),
             engine_pattern=(
                 rf"({service} server [^\n]++(?:\n(?![ \t]+key \S)[ \t][^\n]++)*+\n[ \t]+key )(?:\d+ )?(\S+)"
             )),
    )


STRICT_RULES = (
    Rule("enable_secret", r"(enable (?:secret|password) )(?:(?:\d+|sha512) )?(\S+)", r"\1<removed-enable-secret>", I,
         label="Enable secrets", literals=("enable secret ", "enable password ")),
    Rule("user_secret", r"^([^\S\n]*username )(\S+)( (?:[^\n]*? )?(?:secret|password) )([^\n]+)",
         r"\1\2\3<removed-user-secret>", M, label="User secrets", literals=("username ",)),
    *_server_rules("tacacs"),
    *_server_rules("radius"),
    Rule("snmp_community", r"(snmp-server community )(\S+)", r"\1<removed-snmp-community>",
         label="SNMP communities", verb="checked", literals=("snmp-server community ",),
         counted=r"(snmp-server community )(\S+)",
         engine_pattern=r"(snmp-server community )(?!(?i:ro|rw|read-only|read-write)(?!\S))(\S+)"),
    Rule("mka_key", r"(mka pre-shared-key key-chain )(\S+)", r"\1<removed-mka-key>",
         label="MKA pre-shared keys", literals=("mka pre-shared-key key-chain ",)),
    Rule("isakmp_key", r"(crypto isakmp key )(?:\d+ )?(\S+)", r"\1<removed-isakmp-key>",
         label="ISAKMP keys", literals=("crypto isakmp key ",)),
    Rule("psk",
         r'(?<!mka )(pre-shared-key[ \t]+(?:address [^\n]*?key[ \t]+)?(?:(?:ascii-text|hexadecimal|\d+)[ \t]+)?)'
         r'("[^"\n]*"|\S+)',
         r"\1<removed-psk>", I, label="Pre-shared keys", literals=("pre-shared-key",)),
    Rule("encrypted_password", r'(encrypted-password[ \t]+)("[^"\n]*"|\S+)', r"\1<removed-password>", I,
         label="Juniper encrypted passwords", literals=("encrypted-password",)),
    Rule("ntp_key", r"(ntp authentication-key \d+ md5 )([^\n]+)", r"\1<removed-ntp-key>",
         label="NTP keys", literals=("ntp authentication-key ",)),
    Rule("ospf_auth_key", r"(ip[ \t]+ospf[ \t]+authentication-key[ \t]+)(?:\d+[ \t]+)?(\S+)", r"\1<removed-key>", I,
         label="OSPF auth keys", literals=("authentication-key",)),
    Rule("auth_key", r'(?<!ntp )(?<!ospf )((?:authentication-key|shared-secret)[ \t]+)("[^"\n]*"|\S+)',
         r"\1<removed-key>", I, label="Juniper auth keys", literals=("authentication-key", "shared-secret")),
    Rule("juniper_9_quoted", r'"\$9\$[^"\n]*"', "<removed-encrypted>",
         label="Juniper $9$ encrypted", literals=('"$9$',)),
    Rule("juniper_9_bare", r"(?<!\w)\$9\$[A-Za-z0-9./:@_\-]+", "<removed-encrypted>",
         label="Juniper $9$ encrypted", literals=("$9$",)),
    Rule("password_hash", r"(?<!\w)\$[156]\$[^\s]+", "<removed-hash>",
         label="Password hashes", literals=("$1$", "$5$", "$6$")),
    Rule("md5_key", r"(message-digest-key[ \t]+\d+[ \t]+md5[ \t]+)(?:\d+[ \t]+)?(\S+)", r"\1<removed-ospf-key>", I,
         label="OSPF passwords", literals=("message-digest-key",)),
    Rule("bgp_password", r"(neighbor \S+ password )(?:\d+ )?(\S+)", r"\1<removed-bgp-password>",
         label="BGP passwords", literals=("neighbor ",)),
    Rule("key_string", r"(key-string )(?:\d+ )?(\S+)", r"\1<removed-auth-key>",
         label="AUTH passwords", literals=("key-string ",)),
    Rule("line_password", r"^([ \t]+password )(?:\d+ )?(\S+)", r"\1<removed-line-password>", M,
         label="Line passwords", literals=("password ",)),
)

STRICT = RulePack("strict", STRICT_RULES)
