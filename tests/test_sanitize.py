import random

import brute
import pytest
from pyspark.sql import functions as F

from cfgveil import BUILTIN, LIBRARY, STRICT, RulePack, custom_rules, vendor_pack
from cfgveil.operators import sanitize as san
from cfgveil.packs import SAMPLE_CISCO, VENDOR_PACKS
from cfgveil.rules import pack_from_settings

ROUTER = """hostname EDGE
! saved by john.doe
enable secret 5 $1$aaaa$bbbbbbbbbbbbbb
enable password 7 0123456789AB
username admin privilege 15 secret 5 $1$cc$dddddddd
username john.doe privilege 15 password 7 1122334455
interface Gi0/1
 ip ospf message-digest-key 1 md5 7 99887766
router bgp 65001
 neighbor 203.0.113.2 password 7 AABBCCDD
snmp-server community hidden RO
snmp-server community rw RW
tacacs server ONE
 address ipv4 10.0.0.1
 key 7 FFEEDDCC
!
radius server TWO
  address ipv4 10.0.0.2
  key 7 00112233
!
line vty 0 4
 password 7 5566778899
ntp authentication-key 1 md5 4433221100 7
crypto isakmp key Planted address 203.0.113.9
end"""

GOLDEN = {
    2: "! saved by netadmin1",
    3: "enable secret 5 <removed-enable-secret>",
    4: "enable password 7 <removed-enable-secret>",
    5: "username admin privilege 15 secret 5 <removed-user-secret>",
    6: "username netadmin1 privilege 15 password 7 <removed-user-secret>",
    8: " ip ospf message-digest-key 1 md5 <removed-ospf-key>",
    10: " neighbor 203.0.113.2 password <removed-bgp-password>",
    11: "snmp-server community <removed-snmp-community> RO",
    15: " key 7 <removed-tacacs-key>",
    19: "  key 7 <removed-radius-key>",
    23: "ntp authentication-key <removed-key> md5 4433221100 7",
    24: "crypto isakmp key <removed-isakmp-key> address 203.0.113.9",
}
MESSAGES = [
    "Enable secrets: 2 replaced", "User secrets: 2 replaced", "TACACS keys: 1 replaced", "RADIUS keys: 1 replaced",
    "SNMP communities: 2 checked", "ISAKMP keys: 1 replaced", "Juniper auth keys: 1 replaced", "OSPF auth keys: 1 replaced",
    "BGP passwords: 1 replaced", "OSPF passwords: 1 replaced", "Username john.doe -> netadmin1 (1 occurrences)",
]


def text_of(df, **options):
    return san.sanitize(df, **options).first().sanitized


def test_golden_router(texts):
    row = san.sanitize(texts([ROUTER]), personal=["john.doe", "jane.smith"], service=["admin"]).first()
    expected = [GOLDEN.get(i, line) for i, line in enumerate(ROUTER.split("\n"), 1)]
    assert row.sanitized.split("\n") == expected
    assert row.modified
    assert row.changes == MESSAGES
    assert row.change_count == len(MESSAGES)
    assert sum(f.n for f in row.findings) == 14


def test_clean_text_is_untouched(texts):
    row = san.sanitize(texts(["interface Gi0/1\n ip address 10.0.0.1 255.255.255.0\n"])).first()
    assert (row.modified, row.changes, row.change_count, row.findings) == (False, [], 0, [])


def test_counted_but_unmodified_reports_nothing(texts):
    row = san.sanitize(texts(["snmp-server community RO\n"])).first()
    assert (row.modified, row.changes) == (False, [])


# One literal case per trap the compatible pack keeps (or is documented to differ on).
TRAPS = [
    ("ntp authentication-key 1 md5 SECRET", "ntp authentication-key <removed-key> md5 SECRET"),
    ("ip ospf authentication-key 7 SECRET", "ip ospf authentication-key <removed-key> SECRET"),
    ("tacacs-server key 7 SECRET", "tacacs-server key <removed-tacacs-key> SECRET"),
    ("crypto isakmp key 6 SECRET address 1.1.1.1", "crypto isakmp key <removed-isakmp-key> SECRET address 1.1.1.1"),
    ("enable secret SECRET", "enable secret SECRET"),
    ("username u secret SECRET", "username u secret SECRET"),
    ("snmp-server community a\nsnmp-server community b", "snmp-server community <removed-snmp-community>\nsnmp-server community b"),
    ("mka pre-shared-key key-chain X", "mka pre-shared-key <removed-psk> <removed-mka-key>"),
    ("x message-digest-key 1 md5 7 A message-digest-key 2 md5 7 B", "x message-digest-key 1 md5 7 A message-digest-key 2 md5 <removed-ospf-key>"),
    ("username a secret 5 X\nusername a secret 5 X tail", "username a secret 5 <removed-user-secret>\nusername a secret 5 <removed-user-secret>"),
    ("tacacs server A\n  tacacs server B\n   key 7 K1\n key 7 K2", "tacacs server A\n  tacacs server B\n   key 7 <removed-tacacs-key>\n key 7 K2"),
    ("radius server A\n address x\n key Z\n key 0 Y\nradius server B\n tacacs server\n", "radius server A\n address x\n key Z\n key 0 <removed-radius-key>\nradius server B\n tacacs server\n"),
    ('set k "$9$abc def" $9$zz. a$9$no $6$x$y', "set k <removed-encrypted> <removed-encrypted> a$9$no <removed-hash>"),
]


def test_traps(texts):
    rows = san.sanitize(texts([t for t, _ in TRAPS])).orderBy("path").collect()
    got = {r.content: r.sanitized for r in rows}
    assert got == dict(TRAPS)


def test_two_passes_differ_in_the_compatible_pack(texts):
    once = text_of(texts(["ip ospf message-digest-key 1 md5 7 A"]))
    assert once == "ip ospf message-digest-key 1 md5 <removed-ospf-key>"
    assert text_of(texts([once])) == "ip ospf message-digest-key 1 md5 <removed-key>"


FRAGMENTS = [
    "enable secret 5 {s}", "ENABLE Password 7 ${s}", "username {s} secret 5 {s} x", "  username bob privilege 1 password 0 {s}",
    "tacacs-server key {s}", "TACACS server {s}", " address 1.2.3.4", "\tkey 7 {s}", " key {s}", "   key 0 {s}", "radius server {s}",
    "radius-server key 7 {s}", "snmp-server community {s}", "snmp-server community RO", "snmp-server community {s} RW",
    "mka pre-shared-key key-chain {s}", "crypto isakmp key {s} address 1.1.1.1", " pre-shared-key {s}", "pre-shared-key hexadecimal {s}",
    'x pre-shared-key ascii-text "$9$ {s}"', 'encrypted-password "{s}"', "encrypted-password {s}", "authentication-key {s}",
    'Shared-Secret "{s} {s}"', '"$9${s}"', "$9${s}", "q$9${s}", "$6${s}$x", "_$5${s}", "ip ospf authentication-key {s}",
    "ip  ospf message-digest-key 1  md5 7 {s}", "ip ospf message-digest-key 3 md5 {s}", "ntp authentication-key 1 md5 {s} 7",
    "neighbor 1.1.1.1 password 7 {s}", "neighbor x password {s}", "area 0 message-digest-key 1 md5 7 {s} message-digest-key 2 md5 7 {s}",
    "authentication mode md5 foo key-string 7 {s}", "", " ", "plain text é x", "ſecret İp", "hostname {s}",
]


def random_text(seed):
    rng = random.Random(seed)
    lines = [rng.choice(FRAGMENTS).replace("{s}", rng.choice(["S3cret", "12345", "a.b/c", "7", "$1$zz", "kéy"])) for _ in range(rng.randint(1, 25))]
    return rng.choice(["\n", "\n", "\r\n"]).join(lines)


@pytest.mark.parametrize("rules", [BUILTIN.rules, LIBRARY.rules, STRICT.rules, SAMPLE_CISCO.rules], ids=["builtin", "library", "strict", "sample"])
def test_random_texts_match_plain_python(texts, rules):
    pack = RulePack("p", tuple(rules))
    rows = san.sanitize(texts([random_text(i) for i in range(400)]), builtin=pack).collect()
    assert len(rows) == 400
    for row in rows:
        text, counts = brute.apply(rules, row.content)
        assert row.sanitized == text
        if row.modified and not rules[0].only_if_changed:
            assert {f.rule: f.n for f in row.findings} == counts


def test_text_only_form_agrees(texts):
    df = texts([random_text(i) for i in range(200)])
    full = {r.path: r.sanitized for r in san.sanitize(df).collect()}
    assert {r.path: r.sanitized for r in san.sanitize_text(df).collect()} == full


def test_strict_is_idempotent_and_leaves_no_planted_secret(texts):
    planted = [t.replace("SECRET", f"Planted{i}") for i, (t, _) in enumerate(TRAPS)]
    planted.append(ROUTER.replace("5566778899", "PlantedLine").replace("4433221100", "PlantedNtp"))
    once = san.sanitize(texts(planted), builtin=STRICT)
    assert not [r.sanitized for r in once.collect() if "Planted" in r.sanitized]
    more = texts([random_text(i) for i in range(300)])
    first = san.sanitize(more, builtin=STRICT).select("path", F.col("sanitized").alias("content"))
    assert san.sanitize(first, builtin=STRICT).filter("modified").count() == 0


def test_modified_means_text_changed(texts):
    done = san.sanitize(texts([random_text(i) for i in range(200)]))
    assert done.filter("modified = (content = sanitized)").count() == 0


def test_long_blocks_and_long_lines(texts):
    block = "tacacs server X\n" + " address 1\n" * 60_000 + "   key 7 Planted\n"
    line = "message-digest-key " * 20_000
    rows = san.sanitize(texts([block, line])).orderBy("path").collect()
    assert rows[0].sanitized.endswith(" key 7 <removed-tacacs-key>\n")
    assert not rows[1].modified


def test_vendor_packs(texts):
    df = texts(["enable secret 5 S\nusername bob secret 5 X\nsnmp-server community c RO\n<phash>p</phash>\nenable password sha512 Q\n"])
    for name, pack in VENDOR_PACKS.items():
        text, counts = brute.apply([*BUILTIN.rules, *pack.rules], df.first().content)
        row = san.sanitize(df, custom=vendor_pack(name.upper())).first()
        assert row.sanitized == text
        custom = [c for c in row.changes if c.startswith("Custom pattern")]
        assert custom == [f"Custom pattern '{r.name}': {counts[r.name]} replaced" for r in pack.rules if r.name in counts and r.name not in {b.name for b in BUILTIN.rules}] or name == "cisco"
    with pytest.raises(ValueError, match="Unknown vendor"):
        vendor_pack("acme")


def test_mixed_vendors_in_one_scan(spark):
    text = "enable secret 5 S\n<phash>p</phash>\nenable password sha512 Q\n"
    df = spark.createDataFrame([(v, v, text) for v in ("CISCO", "paloalto", "arista", "other")], "path string, vendor string, content string")
    got = {r.path: r.sanitized for r in san.sanitize_by_vendor(df, list(VENDOR_PACKS)).collect()}
    for vendor, done in got.items():
        pack = VENDOR_PACKS.get(vendor.lower())
        assert done == brute.apply([*BUILTIN.rules, *(pack.rules if pack else ())], text)[0]


def test_custom_rules_and_flag_case(texts):
    df = texts(["custom-secret abc CUSTOM-SECRET def"])
    rules = custom_rules({
        "lower": {"pattern": r"custom-secret (\S+)", "replacement": "x", "flags": ["ignorecase"]},
        "upper": {"pattern": r"custom-secret (\S+)", "replacement": "y", "flags": ["IGNORECASE"]},
    })
    row = san.sanitize(df, custom=rules).first()
    assert row.sanitized == "x y"
    assert row.changes == ["Custom pattern 'lower': 1 replaced", "Custom pattern 'upper': 1 replaced"]


def test_pack_from_settings_and_merge():
    base = pack_from_settings("a", {"service_accounts": ["admin"], "personal_accounts": ["z", "b"], "verbose": True,
                                    "patterns": {"p": {"pattern": "a", "replacement": "1"}, "q": {"pattern": "b", "replacement": "2"}}})
    other = pack_from_settings("b", {"service_accounts": ["root", "admin"], "patterns": {"p": {"pattern": "c", "replacement": "3"}}})
    merged = base.merge(other)
    assert base.personal_accounts == ("b", "z")
    assert merged.service_accounts == ("admin", "root")
    assert [(r.name, r.pattern) for r in merged.rules] == [("p", "c"), ("q", "b")]


def test_library_reports_only_changes(texts):
    row = san.apply_library(texts(["enable secret 5 $REDACTED_ENABLE\nsnmp-server community x\n"])).first()
    assert row.changes == ["SNMP community strings: 1 replaced"]


def test_library_subset_order_and_override(texts):
    df = texts(["snmp-server community secretkey\n"])
    assert san.apply_library(df, ["no_such", "snmp_community"]).first().sanitized == "snmp-server community REDACTED_COMMUNITY\n"
    library = san.override_library({"snmp_community": {"pattern": r"community (\S+)", "replacement": "community Z", "flags": ["ignorecase"]}})
    assert library.names() == LIBRARY.names()
    assert san.apply_library(df, ["snmp_community"], library=library).first().sanitized == "snmp-server community Z\n"


def test_rows_outside_the_condition_pass(spark):
    df = spark.createDataFrame([("a", "enable secret 5 X john", True), ("b", "enable secret 5 X john", False), ("c", "enable secret 5 X john", None)],
                               "path string, content string, ok boolean")
    rows = {r.path: r for r in san.sanitize(df, when=F.col("ok"), personal=["john"]).collect()}
    assert rows["a"].sanitized == "enable secret 5 <removed-enable-secret> netadmin1"
    assert rows["b"].sanitized == rows["c"].sanitized == "enable secret 5 X john"
    assert not rows["b"].modified and not rows["c"].modified


def test_missing_text_is_not_an_error(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "path string, content string")
    rows = san.sanitize(df, personal=["x"]).collect()
    assert [(r.sanitized, r.modified, r.changes) for r in sorted(rows)] == [(None, False, []), ("", False, [])]
