"""Corpora derived from the given tables.

Each is one SQL expression list that Spark and DuckDB both run, so a query and its SQL
twin see the same rows. All derived text is ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.session import dealt, spread
from cfgveil.sources.stores import write_bodies

NL = "chr(10)"
K = "cast(c_custkey as string)"
H = "md5(cast(c_custkey as string))"

# Accounts a derived configuration may name, by customer key.
USER = (
    "case when c_custkey % 8 = 0 then 'john.doe' when c_custkey % 8 = 2 then 'jane.smith' "
    "when c_custkey % 8 = 4 then 'bob.wilson' else 'netops' end"
)


def _h(start: int, length: int) -> str:
    return f"substr({H}, {start}, {length})"


def _lines(condition: str | None, *lines: str) -> str:
    """SQL for a block of lines; `{...}` parts are SQL expressions."""
    parts = []
    for line in lines:
        pieces = line.replace("}", "{").split("{")
        quoted = [f"'{p}'" if i % 2 == 0 else p for i, p in enumerate(pieces) if i % 2 or p]
        parts.append(" || ".join([*quoted, NL]))
    body = " || ".join(parts)
    return f"case when {condition} then {body} else '' end" if condition else body


NOT_CLEAN = "c_custkey % 10 <> 9"


def _when(modulus: int, rest: int = 0) -> str:
    return f"c_custkey % {modulus} = {rest} and {NOT_CLEAN}"


CONFIG_TEXT = " || ".join([
    _lines(None,
           f"hostname R-{{{K}}}",
           "interface GigabitEthernet0/0",
           " description uplink",
           " ip address 10.0.0.{cast(c_custkey % 200 as string)} 255.255.255.0",
           "! owner {c_name}"),
    _lines(NOT_CLEAN,
           f"enable secret 5 $1${{{_h(1, 4)}}}${{{_h(5, 22)}}}",
           f"enable password 7 {{upper({_h(9, 12)})}}"),
    _lines(_when(2),
           f"username admin privilege 15 secret 5 $1${{{_h(3, 4)}}}${{{_h(8, 20)}}}",
           f"username {{{USER}}} privilege 15 password 7 {{upper({_h(2, 14)})}}",
           f"! last change by {{{USER}}}"),
    _lines(_when(6), f"username jane.smith secret 5 $1$zz$ab{{{_h(4, 12)}}} extra tail", "! contact john.doe and jane.smith"),
    _lines(NOT_CLEAN,
           f"tacacs-server key K{{{_h(1, 12)}}}",
           "tacacs server T1",
           " address ipv4 10.9.0.10",
           f"   key 7 {{upper({_h(6, 16)})}}",
           " timeout 5",
           "radius server R1",
           " address ipv4 10.9.0.20",
           f"   key 7 {{upper({_h(7, 16)})}}",
           f"radius-server key Q{{{_h(2, 10)}}}"),
    _lines(NOT_CLEAN,
           f"snmp-server community {{case when c_custkey % 3 = 0 then 'public' else 'C' || {_h(1, 6)} end}} RO",
           f"snmp-server community W{{{_h(7, 6)}}} RW"),
    _lines(_when(5),
           f"mka pre-shared-key key-chain M{{{_h(1, 8)}}}",
           f"crypto isakmp key V{{{_h(3, 10)}}} address 203.0.113.5",
           f" pre-shared-key P{{{_h(5, 10)}}}",
           f"set security ike policy X pre-shared-key ascii-text \"$9${{{_h(1, 16)}}}\"",
           f"set system root-authentication encrypted-password \"$5${{{_h(2, 20)}}}\"",
           f"set protocols ospf area 0 authentication-key \"$9${{{_h(3, 14)}}}\"",
           f"set snmp v3 secret \"$9${{{_h(4, 14)}}}\"",
           f"set snmp v3 other $9${{{_h(5, 12)}}}"),
    _lines(_when(7), f"hash $6${{{_h(1, 8)}}}${{{_h(9, 24)}}}"),
    _lines(_when(3),
           "interface GigabitEthernet0/1",
           f" ip ospf authentication-key 7 {{upper({_h(11, 10)})}}",
           f" ip ospf message-digest-key 1 md5 7 {{upper({_h(12, 14)})}}",
           f"area 1 message-digest-key 2 md5 7 {{upper({_h(13, 14)})}}",
           f"ntp authentication-key 1 md5 {{upper({_h(14, 12)})}} 7",
           "router bgp 65001",
           f" neighbor 203.0.113.2 password 7 {{upper({_h(15, 14)})}}",
           f" authentication mode md5 key-string 7 {{upper({_h(16, 12)})}}"),
    _lines(_when(11),
           "-----BEGIN RSA PRIVATE KEY-----", f"{{{H}}}{{upper({H})}}", "-----END RSA PRIVATE KEY-----",
           "-----BEGIN CERTIFICATE-----", f"{{upper({H})}}", "-----END CERTIFICATE-----",
           f"<password>X{{{_h(1, 8)}}}</password> <phash>Y{{{_h(2, 8)}}}</phash> <api-key>Z{{{_h(3, 8)}}}</api-key>",
           f"<private-key>X{{{_h(4, 8)}}}</private-key> <key>Y{{{_h(5, 8)}}}</key>",
           f"{{chr(123)}}\"password\": \"p{{{_h(6, 10)}}}\", \"token\" : \"t{{{_h(7, 10)}}}\"{{chr(125)}}",
           f"postgresql://app:{{{_h(8, 10)}}}@db.example/x",
           f"aws_secret_access_key = A{{upper({_h(1, 20)})}}",
           f"blob {{upper({H})}}{{{_h(1, 16)}}} end",
           f"secret seed {{{H}}}",
           f"wpa-passphrase W{{{_h(2, 10)}}}",
           f"ldap bind password L{{{_h(3, 10)}}}",
           f"api_key = k{{{_h(4, 16)}}}",
           f"X-API-Key: {{{_h(5, 20)}}}",
           " ip address 192.168.7.{cast(c_custkey % 250 as string)}"),
    _lines(_when(13),
           f"vtp password V{{{_h(1, 8)}}}",
           f" standby 1 authentication md5 key-string S{{{_h(2, 8)}}}",
           f" glbp 1 authentication md5 key-string G{{{_h(3, 8)}}}",
           f" vrrp 1 authentication R{{{_h(4, 8)}}}",
           f" ISIS password I{{{_h(5, 8)}}}",
           f" ip rip authentication key-chain C{{{_h(6, 8)}}}",
           f"dot1x credentials D{{{_h(7, 8)}}}",
           f"wpa-psk ascii 0 W{{{_h(8, 8)}}}",
           f"server-private 10.1.1.1 key A{{{_h(9, 8)}}}",
           f" ip authentication key-chain eigrp 1 E{{{_h(10, 8)}}}",
           f" password 7 {{upper({_h(11, 12)})}}",
           f"my-secret-pattern T{{{_h(12, 8)}}}"),
])

FILE_NAME = (
    f"'R-' || {K} || case when c_custkey % 4 = 0 then '.conf' when c_custkey % 4 = 1 then '.CFG' "
    "when c_custkey % 4 = 2 then '.txt' else '.log' end"
)
FOLDER = "'/configs/site-' || cast(c_nationkey as string)"
VENDOR = (
    "case when c_custkey % 5 = 0 then 'Cisco' when c_custkey % 5 = 1 then 'juniper' "
    "when c_custkey % 5 = 2 then 'arista' when c_custkey % 5 = 3 then 'paloalto' else 'other' end"
)

CONFIG_COLUMNS = {
    "path": f"{FOLDER} || '/' || {FILE_NAME}",
    "filename": FILE_NAME,
    "vendor": VENDOR,
    "archive": "'site-' || cast(c_nationkey as string) || '.zip'",
    "member": f"'cfg/' || {FILE_NAME}",
    "content": CONFIG_TEXT,
}
CONFIGS_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in CONFIG_COLUMNS.items()) + " from customer"

FOLDER_NAMES = "'/configs/' || event_type || '/R-' || cast(user_id as string) || '.conf'"
BACKUP_HASH = "substr(md5(cast(event_id as string)), 1, 8)"


def backups_sql(stamp: str) -> str:
    name = f"'/backups/R-' || cast(user_id as string) || '_' || {stamp} || '_' || {BACKUP_HASH}"
    return (
        f"select {name} || case when event_id % 2 = 0 then '..conf.gz' else '.conf' end as backup_path, "
        f"{FOLDER_NAMES} as original_path, {stamp} as timestamp, {BACKUP_HASH} as file_hash, "
        "event_id % 2 = 0 as compressed, cast(floor(value * 1000) as bigint) as size from events"
    )


LOG_MESSAGE = (
    "case when event_id % 2 = 0 then 'user=' || cast(user_id as string) || ' ' || event_type || ' api_token=' || "
    "md5(cast(event_id as string)) || ' ok' else 'n=' || md5(cast(event_id as string)) || ' ok' end"
)

PERSONAL = ("bob.wilson", "jane.smith", "john.doe")
SERVICE = ("admin", "service")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One derived configuration per customer; the narrow key rows are dealt out before the text is built."""
    wanted = columns or ("path", "filename", "content")
    customers = table(spark, sf_dir, "customer")
    keys = dealt(customers.select("c_custkey", "c_nationkey", "c_name"), customers.count())
    return keys.select(*[F.expr(CONFIG_COLUMNS[c]).alias(c) for c in wanted])


WRITTEN_NAME = r"filename=([^/]+),\d+\.txt$"


def written_configs(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Every configuration as a file of its own below `root`, written by the executors: archive=../filename=NAME,N.txt.

    As a text writer leaves them: one line end at the end, of an empty or missing text too.
    """
    rows = configs(spark, sf_dir, "archive", "filename", "content")
    none = F.lit("__HIVE_DEFAULT_PARTITION__")
    # Rows of one name stay files of their own; a task that runs again gives its rows the same numbers.
    name = F.format_string("archive=%s/filename=%s,%d.txt", F.coalesce("archive", none), F.coalesce("filename", none), F.monotonically_increasing_id())
    body = F.concat(F.regexp_replace(F.coalesce("content", F.lit("")), "\n\\z", ""), F.lit("\n"))
    write_bodies(rows.select(name.alias("name"), F.encode(body, "UTF-8").alias("body")), root)


def config_stream_source(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same configurations as a stream over the customer table."""
    wanted = columns or ("path", "filename", "content")
    schema = table(spark, sf_dir, "customer").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    keys = dealt(rows.select("c_custkey", "c_nationkey", "c_name"), table(spark, sf_dir, "customer").count())
    return keys.select(*[F.expr(CONFIG_COLUMNS[c]).alias(c) for c in wanted])


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stamp = "date_format(ts, 'yyyyMMdd_HHmmss')"
    sql = backups_sql(stamp)
    return spark.sql(sql.replace(" from events", " from {events}"), events=events)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(LOG_MESSAGE).alias("message"))


def log_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select("event_id", F.expr(LOG_MESSAGE).alias("message"))


def raw_text(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """id and content of the given text tables."""
    source = table(spark, sf_dir, name)
    if name == "documents":
        rows = source.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    elif name == "pages":
        rows = source.select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("content"))
    else:
        rows = source.select(
            F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.col("text").alias("content"),
        )
    return spread(rows)


RAW_SQL = {
    "documents": "select cast(doc_id as string) as id, text as content from documents",
    "pages": "select cast(page_id as string) as id, html as content from pages",
    "conversations": "select cast(conv_id as string) || '/' || cast(turn as string) as id, text as content from conversations",
}
