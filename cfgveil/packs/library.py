"""The named pattern library: detect, count and replace, independent of the sanitize path."""

from __future__ import annotations

from cfgveil.rules import Rule, RulePack

I = ("IGNORECASE",)  # noqa: E741
M = ("MULTILINE",)


def _entry(name, pattern, replacement, flags, description, literals, secret_group=None) -> Rule:
    return Rule(
        name, pattern, replacement, flags, description,
        literals=literals, secret_group=secret_group, only_if_changed=True,
    )


# Names, patterns, replacements and descriptions of the library.
LIBRARY_RULES = (
    _entry("enable_secret", r"(enable (?:secret|password) )(\d+)( \S+)", r"\1\2 $REDACTED_ENABLE", I,
           "Cisco enable secrets and passwords", ("enable secret ", "enable password ")),
    _entry("username_secret", r"(username \S+ .*(?:secret|password) )(\d+)( \S+)", r"\1\2 $REDACTED_SECRET", (),
           "Username passwords and secrets", ("username ",)),
    _entry("tacacs_key", r"(tacacs.*key )(\d+)?(\s*)(\S+)", r"\1\2\3REDACTED_TACACS", I,
           "TACACS+ server keys", ("tacacs",)),
    _entry("radius_key", r"(radius.*key )(\d+)?(\s*)(\S+)", r"\1\2\3REDACTED_RADIUS", I,
           "RADIUS server keys", ("radius",)),
    _entry("snmp_community", r"(snmp-server community )(\S+)", r"\1REDACTED_COMMUNITY", (),
           "SNMP community strings", ("snmp-server community ",)),
    _entry("ospf_auth", r"(message-digest-key \d+ md5 )(\d+)?(\s*)(\S+)", r"\1\2\3REDACTED_OSPF", (),
           "OSPF MD5 authentication keys", ("message-digest-key ",)),
    _entry("bgp_password", r"(neighbor \S+ password )(\d+)?(\s*)(\S+)", r"\1\2\3REDACTED_BGP", (),
           "BGP neighbor passwords", ("neighbor ",)),
    _entry("preshared_key", r"(pre-?shared-key )(\S+)", r"\1REDACTED_PSK", I,
           "VPN pre-shared keys", ("shared-key ",)),
    _entry("key_string", r"(key-string )(\d+)?(\s*)([0-9A-Fa-f]+)", r"\1\2\3REDACTED_KEY", (),
           "Encrypted key strings", ("key-string ",)),
    _entry("wpa_passphrase", r"(wpa-passphrase )(\S+)", r"\1REDACTED_WPA", I,
           "WPA/WPA2 passphrases", ("wpa-passphrase ",)),
    _entry("api_key", r'(api[_-]?key["\s=:]+)([a-zA-Z0-9\-_]+)', r"\1REDACTED_API_KEY", I,
           "API keys in various formats", ("apikey", "api_key", "api-key")),
    _entry("private_key_block",
           r"(-----BEGIN [A-Z ]+PRIVATE KEY-----)[\s\S]+?(-----END [A-Z ]+PRIVATE KEY-----)",
           r"\1\n[REDACTED_PRIVATE_KEY]\n\2", M,
           "Private key blocks (RSA, DSA, EC, etc.)", ("PRIVATE KEY-----",), 0),
    _entry("certificate", r"(-----BEGIN CERTIFICATE-----)[\s\S]+?(-----END CERTIFICATE-----)",
           r"\1\n[REDACTED_CERTIFICATE]\n\2", M,
           "Certificate blocks", ("-----BEGIN CERTIFICATE-----",), 0),
    _entry("xml_password",
           r"(<(?:password|secret|key|passphrase)>)[^<]+(</(?:password|secret|key|passphrase)>)",
           r"\1REDACTED\2", I,
           "Passwords in XML format", ("<password>", "<secret>", "<key>", "<passphrase>"), 0),
    _entry("json_secret", r'("(?:password|secret|key|token|api_key)"\s*:\s*")[^"]+(")', r"\1REDACTED\2", I,
           "Secrets in JSON format", ('password"', 'secret"', 'key"', 'token"'), 0),
    _entry("base64_potential", r'(["\s])([A-Za-z0-9+/]{40,}={0,2})(["\s])', r"\1REDACTED_BASE64\3", (),
           "Potential base64 encoded secrets", (), 2),
    _entry("hex_key", r"((?:key|secret|password).*?)([0-9A-Fa-f]{32,})", r"\1REDACTED_HEX", I,
           "Hexadecimal keys and secrets", ("key", "secret", "password")),
    _entry("ldap_password", r"(ldap.*password )(\S+)", r"\1REDACTED_LDAP", I,
           "LDAP passwords", ("ldap",)),
    _entry("database_url", r"((?:mysql|postgresql|mongodb|redis)://[^:]+:)([^@]+)(@)", r"\1REDACTED\3", I,
           "Database connection URLs with passwords", ("mysql://", "postgresql://", "mongodb://", "redis://"), 2),
    _entry("aws_secret", r"(aws_secret_access_key\s*=\s*)(\S+)", r"\1REDACTED_AWS_SECRET", I,
           "AWS secret access keys", ("aws_secret_access_key",)),
)

LIBRARY = RulePack("library", LIBRARY_RULES)
