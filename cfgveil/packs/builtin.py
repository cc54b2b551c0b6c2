"""The built-in rules of the sanitize path, in execution order.

Order is part of the data: later rules see what earlier ones wrote, and this pack
keeps that order together with its known leaks. `strict.py` is the repaired pack.
"""

from __future__ import annotations

from cfgveil.rules import Rule, RulePack

I = ("IGNORECASE",)  # noqa: E741
M = ("MULTILINE",)


def _server_block(service: str) -> Rule:
    """First typed key of each indented ``<service> server`` block.

    The engine form walks the block possessively, one line at a time, and stops at the
    first key line, so a block of any length needs no backtracking stack.
    """
    return Rule(
        name=f"{service}_server_block",
        pattern=rf"({service} server [^\n]+(?:\n[ \t]+(?!{service} server)[^\n]+)*?\n[ \t]+key )(\d+)( )(\S+)",
        replacement=rf"\1\2 <removed-{service}-key>",
        flags=("IGNORECASE", "MULTILINE"),
        label=f"{service.upper()} keys",
        literals=(f"{service} server ",),
        engine_pattern=(
            rf"({service} server [^\n]++"
            rf"(?:\n(?![ \t]{service} server)(?![ \t]+key \d+ \S)[ \t][^\n]++)*+"
            r"\n[ \t]+key )(\d+)( )(\S+)"
        ),
        secret_group=4,
    )


def _server_global(service: str) -> Rule:
    return Rule(
        name=f"{service}_server_key",
        pattern=rf"({service}-server key )(\S+)",
        replacement=rf"\1<removed-{service}-key>",
        flags=I,
        label=f"{service.upper()} keys",
        literals=(f"{service}-server key ",),
    )


# Patterns, replacements and labels that rewritten texts must agree with.
BUILTIN_RULES = (
    Rule("enable_secret", r"(enable (?:secret|password) )(\d+)( \$?\S+)", r"\1\2 <removed-enable-secret>",
         I, label="Enable secrets", literals=("enable secret ", "enable password ")),
    Rule("user_secret", r"^([^\S\n]*username )(\S+)( .*)?(secret|password)( )(\d+)( )(\S+)(.*)?",
         r"\1\2\3\4\5\6 <removed-user-secret>", M, label="User secrets", literals=("username ",), secret_group=8),
    _server_global("tacacs"),
    _server_block("tacacs"),
    _server_global("radius"),
    _server_block("radius"),
    Rule("snmp_community", r"(snmp-server community )(\S+)(\s+\S+)?", r"\1<removed-snmp-community>\3",
         label="SNMP communities", verb="checked", literals=("snmp-server community ",),
         counted=r"(snmp-server community )(\S+)(\s+\S+)?",
         engine_pattern=r"(snmp-server community )(?!(?i:ro|rw|read-only|read-write)(?!\S))(\S+)(\s+\S+)?",
         secret_group=2),
    Rule("mka_key", r"(mka pre-shared-key key-chain )(\S+)", r"\1<removed-mka-key>",
         label="MKA pre-shared keys", literals=("mka pre-shared-key key-chain ",)),
    Rule("isakmp_key", r"(crypto isakmp key )(\S+)( .*)", r"\1<removed-isakmp-key>\3",
         label="ISAKMP keys", literals=("crypto isakmp key ",), secret_group=2),
    Rule("psk_line", r"^(\s*pre-shared-key )(\S+)", r"\1<removed-psk>", M,
         label="Pre-shared keys", literals=("pre-shared-key ",)),
    Rule("juniper_psk", r'(pre-shared-key\s+(?:ascii-text|hexadecimal)?\s*)("[^"]*"|\S+)', r"\1<removed-psk>", I,
         label="Juniper PSK", literals=("pre-shared-key",)),
    Rule("juniper_encrypted_password", r'(encrypted-password\s+)("[^"]*"|\S+)', r"\1<removed-password>", I,
         label="Juniper encrypted passwords", literals=("encrypted-password",)),
    Rule("juniper_auth_key", r'((?:authentication-key|shared-secret)\s+)("[^"]*"|\S+)', r"\1<removed-key>", I,
         label="Juniper auth keys", literals=("authentication-key", "shared-secret")),
    Rule("juniper_9_quoted", r'"\$9\$[^"]*"', "<removed-encrypted>",
         label="Juniper $9$ encrypted", literals=('"$9$',)),
    # The engine forms of these two look behind only where the literal was found.
    Rule("juniper_9_bare", r"(?<!\w)\$9\$[A-Za-z0-9./:@_\-]+", "<removed-encrypted>",
         label="Juniper $9$ encrypted", literals=("$9$",),
         engine_pattern=r"\$9\$(?<!\w\$9\$)[A-Za-z0-9./:@_\-]+"),
    Rule("password_hash", r"(?<!\w)\$[156]\$[^\s]+", "<removed-hash>",
         label="Password hashes", literals=("$1$", "$5$", "$6$"),
         engine_pattern=r"\$[156]\$(?<!\w\$[156]\$)[^\s]+"),
    Rule("ospf_auth_key", r"(ip\s+ospf\s+authentication-key\s+)(\S+)", r"\1<removed-key>", I,
         label="OSPF auth keys", literals=("authentication-key",)),
    Rule("ospf_md5_key", r"(ip\s+ospf\s+message-digest-key\s+\d+\s+md5\s+)(\d+\s+)?(\S+)", r"\1\2<removed-key>", I,
         label="OSPF auth keys", literals=("message-digest-key",),
         counted=r"ip\s+ospf\s+message-digest-key\s+\d+\s+md5\s+"),
    Rule("ntp_key", r"(ntp authentication-key \d+ md5 )(\d+)?(\s*)(\S+)", r"\1<removed-ntp-key>",
         label="NTP keys", literals=("ntp authentication-key ",)),
    Rule("bgp_password", r"(neighbor \S+ password )(\d+)( )(\S+)", r"\1<removed-bgp-password>",
         label="BGP passwords", literals=("neighbor ",)),
    # Greedy `.*` picks the last key of a line; the engine form finds it by its literal
    # instead of trying the whole line from every character.
    Rule("ospf_password", r"(.*message-digest-key \d+ md5 )(\d+)( )(\S+)", r"\1<removed-ospf-key>",
         label="OSPF passwords", literals=("message-digest-key ",),
         engine_pattern=r"(message-digest-key \d+ md5 )(\d+)( )(?!.*message-digest-key \d+ md5 \d+ \S)(\S+)",
         secret_group=4),
    Rule("auth_key_string", r"(authentication mode md5.*key-string )(\d+)( )(\S+)", r"\1<removed-auth-key>",
         label="AUTH passwords", literals=("authentication mode md5",)),
)

BUILTIN = RulePack("builtin", BUILTIN_RULES)
