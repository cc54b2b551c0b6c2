"""Every operator as a query over the given tables: (spark, sf_dir) -> DataFrame.

Arrays and structs are rendered as text or unnested, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil import jobs, packs
from cfgveil.functions import text as tx
from cfgveil.functions.logs import redact_log
from cfgveil.functions.sql import register_pack
from cfgveil.operators import accounts as acc
from cfgveil.operators import archives as arc
from cfgveil.operators import backups as bak
from cfgveil.operators import detect as det
from cfgveil.operators import report as rep
from cfgveil.operators import sanitize as san
from cfgveil.operators.ranking import numbered
from cfgveil.plans import fixtures as fx
from cfgveil.rules import Rule, RulePack, custom_rules, library_rules, pack_from_settings, rules_frame
from cfgveil.session import dealt, materialized, new_dir
from cfgveil.sinks import files as sinks
from cfgveil.sources import files as src
from cfgveil.sources.stores import list_folder, write_bodies
from cfgveil.streaming import streams as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime(2024, 1, 31, 12, 0, 0)
GENERATED_AT = "2024-01-31T12:00:00"
RETENTION_DAYS = 15
SUBSET = ("snmp_community", "hex_key", "enable_secret")
DOCUMENT_RULES = custom_rules({
    "ipv4": {"pattern": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "replacement": "X.X.X.X"},
    "email": {"pattern": r"([A-Za-z0-9._-]+)@([A-Za-z0-9-]+\.[A-Za-z0-9.-]+)", "replacement": r"<\2:\1>",
              "literals": ["@"]},
})
AUDITED = (
    *packs.SAMPLE_CISCO.rules,
    Rule("broken", r"test [invalid", "x"),
    Rule("never", r"no such text \d+ anywhere", "x"),
    Rule("recursive", r"(?:a|b)+c", "x"),
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _long(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def _joined(column: str, separator: str = "; ") -> Column:
    return F.array_join(column, separator).alias(column)


def _rewritten(df: DataFrame, key: str = "path") -> DataFrame:
    return df.select(key, "sanitized", "modified", _long("change_count"), _joined("changes"))


# Sanitize ---------------------------------------------------------------------------


@query
def sanitize_builtin(spark, sf_dir):
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir)))


@query
def sanitize_text_only(spark, sf_dir):
    return san.sanitize_text(fx.configs(spark, sf_dir)).select("path", "sanitized")


@query
def sanitize_accounts(spark, sf_dir):
    done = san.sanitize(fx.configs(spark, sf_dir), personal=fx.PERSONAL, service=fx.SERVICE)
    return _rewritten(done)


@query
def sanitize_documents(spark, sf_dir):
    return _rewritten(san.sanitize(fx.raw_text(spark, sf_dir, "documents")), "id")


@query
def sanitize_custom(spark, sf_dir):
    return _rewritten(san.sanitize(fx.raw_text(spark, sf_dir, "documents"), custom=DOCUMENT_RULES), "id")


def _vendor_query(vendor: str) -> Query:
    def run(spark, sf_dir):
        return _rewritten(san.sanitize(fx.configs(spark, sf_dir), custom=packs.vendor_pack(vendor)))

    run.__name__ = f"sanitize_vendor_{vendor}"
    return run


for _vendor in packs.VENDOR_PACKS:
    query(_vendor_query(_vendor))


@query
def sanitize_by_vendor(spark, sf_dir):
    rows = fx.configs(spark, sf_dir, "path", "vendor", "content")
    return _rewritten(san.sanitize_by_vendor(rows, list(packs.VENDOR_PACKS)))


@query
def sanitize_sample_basic(spark, sf_dir):
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir), custom=packs.SAMPLE_BASIC, personal=(), service=()))


@query
def sanitize_sample_cisco(spark, sf_dir):
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir), custom=packs.SAMPLE_CISCO, personal=(), service=()))


@query
def sanitize_sample_readme(spark, sf_dir):
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir), custom=packs.SAMPLE_README))


@query
def sanitize_strict(spark, sf_dir):
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir), builtin=packs.STRICT))


@query
def strict_idempotent(spark, sf_dir):
    """Files that a second strict pass would change: none."""
    once = san.sanitize(fx.configs(spark, sf_dir), builtin=packs.STRICT).select("path", F.col("sanitized").alias("content"))
    return san.sanitize(once, builtin=packs.STRICT).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("modified").alias("changed_again")
    )


@query
def findings_long(spark, sf_dir):
    found = san.findings(san.sanitize(fx.configs(spark, sf_dir)), "path")
    return found.select("path", _long("ordinal"), "rule", "label", "n")


# Library: replace, detect, count ----------------------------------------------------


@query
def apply_library(spark, sf_dir):
    return _rewritten(san.apply_library(fx.configs(spark, sf_dir)))


@query
def apply_library_subset(spark, sf_dir):
    return _rewritten(san.apply_library(fx.configs(spark, sf_dir), SUBSET))


def _raw_queries(name: str) -> None:
    def apply(spark, sf_dir):
        return _rewritten(san.apply_library(fx.raw_text(spark, sf_dir, name)), "id")

    def detect(spark, sf_dir):
        found = det.detect_secrets(fx.raw_text(spark, sf_dir, name), ["id"])
        return found.select("id", _long("ordinal"), "rule", _long("position"), "value")

    def stats(spark, sf_dir):
        return det.pattern_stats(fx.raw_text(spark, sf_dir, name), ["id"]).select("id", _long("ordinal"), "rule", "n")

    for run, prefix in ((apply, "apply_library"), (detect, "detect_secrets"), (stats, "pattern_stats")):
        run.__name__ = f"{prefix}_{name}"
        query(run)


for _name in fx.RAW_SQL:
    _raw_queries(_name)


@query
def detect_secrets(spark, sf_dir):
    found = det.detect_secrets(fx.configs(spark, sf_dir), ["path"])
    return found.select("path", _long("ordinal"), "rule", _long("position"), "value")


@query
def detect_secret_values(spark, sf_dir):
    """As detect_secrets, but with the group that holds the secret and without the preview limit."""
    found = det.detect_secrets(fx.configs(spark, sf_dir), ["path"], shown=None, secret_group=True)
    return found.select("path", _long("ordinal"), "rule", _long("position"), "value")


@query
def detections_map(spark, sf_dir):
    found = det.detections_map(fx.configs(spark, sf_dir), ["path"])
    entries = F.transform(
        F.array_sort(F.map_entries("detections")),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")),
    )
    return found.select("path", F.array_join(entries, ";").alias("detections"))


@query
def pattern_stats(spark, sf_dir):
    return det.pattern_stats(fx.configs(spark, sf_dir), ["path"]).select("path", _long("ordinal"), "rule", "n")


@query
def rule_audit(spark, sf_dir):
    audited = det.rule_audit(fx.configs(spark, sf_dir), AUDITED)
    return audited.select(_long("ordinal"), "rule", "valid", "recursion_risk", "hits", "files")


RISKY = (
    Rule("doubled", r"(?:[a-z]+)+;", "x"), Rule("either", r"(?:o|w|ow)*ner!", "x"), Rule("twice", r"\d+\d+x", "x"), Rule("plain", r"owner (\S+)", "x"),
    Rule("spaces", r"owner\s*\n?\s*#", "x"), Rule("done", r"owner(\s*)(\S*)", "x"),
)


@query
def rule_ambiguity(spark, sf_dir):
    """Rules whose patterns can read one text in many ways, beside what they find."""
    audited = det.rule_audit(fx.configs(spark, sf_dir), [*RISKY, *packs.VENDOR_PACKS["cisco"].rules])
    return audited.select(_long("ordinal"), "rule", "valid", "ambiguity", (F.col("witness").isNotNull()).alias("shown"), "hits", "files")


@query
def pack_coverage(spark, sf_dir):
    covered = det.pack_coverage(fx.configs(spark, sf_dir), packs.VENDOR_PACKS)
    return covered.select("pack", _long("rules"), _long("rules_hit"), "hits", "files")


@query
def pack_coverage_library(spark, sf_dir):
    covered = det.pack_coverage(fx.raw_text(spark, sf_dir, "documents"), [packs.LIBRARY])
    return covered.select("pack", _long("rules"), _long("rules_hit"), "hits", "files")


@query
def detection_preview(spark, sf_dir):
    """The first matches of each rule and text."""
    found = det.detection_preview(fx.configs(spark, sf_dir), ["path"], LINE_PACK)
    return found.select("path", _long("ordinal"), "rule", _long("position"), "value")


LINE_PACK = packs.LIBRARY.override(library_rules({"any_line": {"pattern": r"(?m)^ ?(\w+)", "replacement": "x"}}))

# Rules for tables that hold no device configuration.
PAGE_RULES = RulePack("pages", library_rules({
    "link": {"pattern": r'href="([^"]*)"', "replacement": 'href=""', "literals": ["href="]},
    "script": {"pattern": r"<script>[^<]*", "replacement": "<script>", "literals": ["<script>"]},
    "comment": {"pattern": r"<!-- (\w+ \d+) -->", "replacement": "", "literals": ["<!--"]},
}))
TALK_RULES = RulePack("talk", library_rules({
    "the": {"pattern": r"\b(the|of)\b", "replacement": "-", "flags": ["IGNORECASE"]},
    "capital": {"pattern": r"(?m)^[A-Z][a-z]+", "replacement": "X"},
}))


def _other_text_queries(name: str, pack: RulePack) -> None:
    def detect(spark, sf_dir):
        found = det.detect_secrets(fx.raw_text(spark, sf_dir, name), ["id"], pack)
        return found.select("id", _long("ordinal"), "rule", _long("position"), "value")

    def stats(spark, sf_dir):
        return det.pattern_stats(fx.raw_text(spark, sf_dir, name), ["id"], pack).select("id", _long("ordinal"), "rule", "n")

    for run, prefix in ((detect, "detect_custom"), (stats, "pattern_stats_custom")):
        run.__name__ = f"{prefix}_{name}"
        query(run)


_other_text_queries("pages", PAGE_RULES)
_other_text_queries("conversations", TALK_RULES)


@query
def detect_secrets_indexed(spark, sf_dir):
    """As detect_secrets, each text meeting only the rules whose literal it holds."""
    found = det.detect_secrets_indexed(fx.configs(spark, sf_dir), ["path"], packs.LIBRARY.rules)
    return found.select("path", _long("ordinal"), "rule", _long("position"), "value")


# As many rules as anyone keeps: half of them ignore case, one names no literal.
MANY_RULES = tuple(
    Rule(f"host_{k}", rf"hostname R-{k}\b", "hostname X", flags=("IGNORECASE",) if k % 2 else (), literals=(f"hostname r-{k}" if k % 2 else f"hostname R-{k}",))
    for k in range(500)
) + (Rule("interface", r"interface \S+", "interface X"),)


@query
def pattern_stats_indexed(spark, sf_dir):
    """501 rules in one pass."""
    return det.pattern_stats_indexed(fx.configs(spark, sf_dir), ["path"], MANY_RULES).select("path", _long("ordinal"), "rule", "n")


# Packs of a user's own, and in SQL -------------------------------------------------------


MERGED = packs.SAMPLE_BASIC.merge(pack_from_settings("own", {
    "patterns": {
        "vtp": {"pattern": r"vtp password (\S+)", "replacement": "vtp password <gone>", "description": "VTP"},
        packs.SAMPLE_BASIC.rules[0].name: {"pattern": r"(?m)^! owner .*$", "replacement": "! owner <gone>"},
    },
    "service_accounts": ["admin"],
    "personal_accounts": ["zoe", "adam"],
}))


@query
def sanitize_merged_pack(spark, sf_dir):
    """A sample pack merged with a user's settings: one rule new, one in the place of a sample's."""
    return _rewritten(san.sanitize(fx.configs(spark, sf_dir), custom=MERGED, personal=(), service=()))


@query
def rules_table(spark, sf_dir):
    """How often each rule of the merged pack hits, joined to the pack as a table."""
    rules = rules_frame(spark, [MERGED])
    hits = det.pattern_stats(fx.configs(spark, sf_dir), ["path"], MERGED).groupBy(F.col("rule").alias("name")).agg(F.sum("n").alias("hits"))
    return rules.join(hits, "name", "left").select("pack", _long("ordinal"), "name", "pattern", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


@query
def sql_sanitize(spark, sf_dir):
    """The built-in pack as a SQL function."""
    text, *_ = register_pack(spark, packs.BUILTIN, "cfgveil_builtin")
    return spark.sql(f"SELECT path, {text}(content) AS sanitized FROM {{configs}}", configs=fx.configs(spark, sf_dir))


@query
def sql_findings(spark, sf_dir):
    """The library as a SQL table function, joined to the rules as another."""
    _, findings, rules = register_pack(spark, packs.LIBRARY, "cfgveil_library")
    return spark.sql(
        f"""SELECT c.path, cast(f.ordinal AS bigint) AS ordinal, r.rule, cast(f.position AS bigint) AS position, f.value
        FROM {{configs}} c, LATERAL {findings}(c.content) f JOIN {rules}() r ON r.ordinal = f.ordinal""",
        configs=fx.configs(spark, sf_dir),
    )


# Accounts ---------------------------------------------------------------------------


def _accounts(spark: SparkSession) -> DataFrame:
    return acc.accounts_frame(spark, fx.PERSONAL, fx.SERVICE)


def _customer_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("username"), F.lit("personal").alias("kind"), (F.col("c_custkey") + 1).cast("int").alias("ordinal")
    )


def _user_rule() -> Rule:
    return next(r for r in packs.BUILTIN.rules if r.name == san.USER_RULE)


@query
def accounts_merged(spark, sf_dir):
    merged = acc.merge_accounts(_customer_accounts(spark, sf_dir), _accounts(spark).unionByName(_customer_accounts(spark, sf_dir)))
    return merged.select("username", "kind", _long("ordinal"))


@query
def rename_accounts(spark, sf_dir):
    done = acc.rename_accounts(fx.configs(spark, sf_dir, "path", "content"), _accounts(spark))
    return done.select("path", F.col("renamed").alias("sanitized"), F.array_join(acc.rename_messages(F.col("hits")), "; ").alias("changes"))


@query
def rename_customers(spark, sf_dir):
    """As many personal accounts as customers: the equi-join form."""
    done = acc.rename_accounts(fx.configs(spark, sf_dir, "path", "content"), _customer_accounts(spark, sf_dir))
    return done.select("path", F.col("renamed").alias("sanitized"), F.array_join(acc.rename_messages(F.col("hits")), "; ").alias("changes"))


@query
def sanitize_then_rename(spark, sf_dir):
    """Sanitize first, then rename by an account table of any size, user lines first."""
    done = materialized(san.sanitize(fx.configs(spark, sf_dir)).select("path", "sanitized"), "sanitized")
    every = _accounts(spark).unionByName(_customer_accounts(spark, sf_dir).withColumn("ordinal", F.col("ordinal") + 1000))
    named = acc.rename_accounts(done, every, content="sanitized", user_lines=True)
    return named.select("path", F.col("renamed").alias("sanitized"))


@query
def account_occurrences(spark, sf_dir):
    both = _customer_accounts(spark, sf_dir).unionByName(_accounts(spark))
    return acc.account_occurrences(fx.configs(spark, sf_dir, "path", "content"), both)


@query
def username_lines(spark, sf_dir):
    lines = acc.username_lines(fx.configs(spark, sf_dir, "path", "content"), _user_rule())
    return lines.select("path", _long("line_no"), "username", "line")


@query
def service_lines(spark, sf_dir):
    lines = acc.username_lines(fx.configs(spark, sf_dir, "path", "content"), _user_rule())
    return acc.members_of(lines, _accounts(spark), "service").select("path", _long("line_no"), "username")


@query
def pseudonyms(spark, sf_dir):
    lines = acc.username_lines(fx.configs(spark, sf_dir, "path", "content"), _user_rule())
    return acc.pseudonyms(lines, _accounts(spark)).select("path", "username", _long("first_line"), "alias")


@query
def server_block_keys(spark, sf_dir):
    rows = fx.configs(spark, sf_dir, "path", "content")
    found = acc.server_block_keys(rows, ["tacacs", "radius"])
    return found.select("path", "service", "block", _long("line_no"), "key_type", "secret")


# Results and reports ----------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return san.sanitize(fx.configs(spark, sf_dir, *(columns or ("path", "filename", "content"))))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured path, plus an invented one for every customer."""
    names = fx.configs(spark, sf_dir, "path")
    invented = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/configs/absent/R-"), F.col("c_custkey").cast("string"), F.lit(".conf")).alias("path")
    )
    return names.unionByName(invented)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.missing_inputs(_requested(spark, sf_dir), fx.configs(spark, sf_dir, "path"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp, digest = F.lit("20240131_120000"), tx.content_hash(F.col("content"), 8)
    backup = bak.backup_path(F.col("path"), stamp, digest, "/backups")
    return rep.with_errors(rep.results(_run(spark, sf_dir), backup=backup), _missing(spark, sf_dir))


@query
def secrets_by_type(spark, sf_dir):
    return rep.secrets_by_type(_run(spark, sf_dir))


@query
def secrets_by_type_merged(spark, sf_dir):
    """Stored sketches of five parts of the corpus added up, beside the exact counts; how far the estimate is off."""
    done = _run(spark, sf_dir, "path", "filename", "vendor", "content")
    parts = materialized(rep.label_sketches(done, ["vendor"]), "sketches")
    merged = rep.merged_sketches(parts).withColumnRenamed("affected_files", "estimate")
    both = rep.secrets_by_type(done).join(merged.drop("total_count"), "label").join(merged.select("label", F.col("total_count").alias("merged_count")), "label")
    near = F.abs(F.col("estimate") - F.col("affected_files")) <= 0.1 * F.col("affected_files")
    return both.select("label", "total_count", "merged_count", "affected_files", near.alias("near"))


@query
def results_written(spark, sf_dir):
    """Results written as JSON lines and as CSV, read back and compared."""
    rows = materialized(_results(spark, sf_dir), "results")
    as_json, as_csv = new_dir(spark, "json"), new_dir(spark, "csv")
    sinks.write_results_json(rows, as_json, stats_out=new_dir(spark, "stats"))
    sinks.write_results_csv(rows, as_csv)
    read = spark.read.schema("file string, modified boolean, change_count bigint, error string").json(as_json)
    lines = spark.read.option("header", "true").csv(as_csv)
    counted = lines.groupBy(F.col("File").alias("name"), F.col("Changes").cast("bigint").alias("change_count")).agg(F.count(F.lit(1)).alias("lines"))
    return read.withColumn("name", tx.file_name(F.col("file"))).join(counted, ["name", "change_count"], "left").select("file", "modified", "change_count", "error", "lines")


@query
def results(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rows.select("file", "modified", _joined("changes"), _long("change_count"), "error", "backup")


@query
def results_csv(spark, sf_dir):
    return rep.results_csv(_results(spark, sf_dir)).withColumn("Changes", F.col("Changes").cast("bigint"))


@query
def results_json(spark, sf_dir):
    return rep.results_json(_results(spark, sf_dir))


@query
def run_stats(spark, sf_dir):
    return rep.run_stats(_results(spark, sf_dir))


@query
def top_changed(spark, sf_dir):
    top = rep.top_changed(rep.results(_run(spark, sf_dir)))
    return top.select("file", _long("change_count"))


@query
def parse_change(spark, sf_dir):
    done = san.sanitize(fx.configs(spark, sf_dir), personal=fx.PERSONAL, service=fx.SERVICE)
    parsed = done.select("path", F.explode("changes").alias("change")).withColumn("p", rep.parse_change(F.col("change")))
    return parsed.select("path", "change", "p.type", F.col("p.count").cast("bigint").alias("count"))


@query
def file_details(spark, sf_dir):
    shown = F.array_join(F.transform("secrets", lambda s: F.concat(s["label"], F.lit("="), s["n"].cast("string"))), ";")
    return rep.file_details(_run(spark, sf_dir)).select("path", "filename", _long("changes"), shown.alias("secrets"))


@query
def security_summary(spark, sf_dir):
    return rep.security_summary(_run(spark, sf_dir))


def _archived_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per archive, written once: a report reads them several times."""
    done = _run(spark, sf_dir, "path", "filename", "archive", "content")
    slim = done.select("archive", "path", "filename", "modified", "change_count", "findings")
    return materialized(slim, "results")


@query
def security_report(spark, sf_dir):
    report = rep.security_report(_archived_run(spark, sf_dir), GENERATED_AT)
    shown = F.transform(
        "secrets_by_type",
        lambda t: F.concat_ws("=", t["label"], t["total_count"].cast("string"), t["affected_files"].cast("string")),
    )
    return report.select(
        "archive", "report_metadata.generated_at", "archive_info.total_files_extracted", "archive_info.total_files_sanitized",
        "security_summary.total_secrets_found", "security_summary.files_containing_secrets",
        "security_summary.secret_types_detected", F.array_join(shown, ";").alias("secrets_by_type"),
    )


def _report_query(fmt: str) -> Query:
    def run(spark, sf_dir):
        lines = rep.report_lines(_archived_run(spark, sf_dir), GENERATED_AT, fmt)
        return lines.select("archive", _long("section"), "idx", "line")

    run.__name__ = f"report_{fmt}"
    return run


for _fmt in rep.FORMATS:
    query(_report_query(_fmt))


# Files, paths and archives ----------------------------------------------------------


@query
def missing_inputs(spark, sf_dir):
    return _missing(spark, sf_dir)


@query
def file_list(spark, sf_dir):
    return src.file_list(_requested(spark, sf_dir))


@query
def classify_files(spark, sf_dir):
    return fx.configs(spark, sf_dir, "member").select("member", arc.is_config_file(F.col("member")).alias("is_config"),
                                                      arc.is_config_file(tx.file_name(F.col("member"))).alias("name_is_config"))


@query
def path_parts(spark, sf_dir):
    path = F.col("path")
    return fx.configs(spark, sf_dir, "path").select(
        "path", tx.file_name(path).alias("name"), tx.file_stem(path).alias("stem"), tx.file_suffix(path).alias("suffix"),
        tx.parent_dir(path).alias("parent"), tx.relative_path(path, "/configs").alias("relative"),
    )


@query
def sanitized_names(spark, sf_dir):
    path = F.col("path")
    return fx.configs(spark, sf_dir, "path").select(
        "path",
        tx.sanitized_name(path).alias("in_place"),
        tx.sanitized_name(tx.sanitized_name(path)).alias("again"),
        tx.sanitized_name(path, extension=".tar.gz").alias("as_tar"),
        tx.sanitized_name(path, extension="", stamp=F.lit("20240131_120000")).alias("folder"),
    )


@query
def archive_types(spark, sf_dir):
    """Types by name, over the customers' file names with each known suffix in turn."""
    suffixes = F.array(*[F.lit(s) for s in [*arc.ARCHIVE_SUFFIXES, ".conf"]])
    keys = fx.table(spark, sf_dir, "customer").select("c_custkey")
    suffix = F.element_at(suffixes, (F.col("c_custkey") % 14 + 1).cast("int"))
    name = F.concat(F.lit("A-"), F.col("c_custkey").cast("string"), suffix)
    named = keys.select(F.when(F.col("c_custkey") % 2 == 0, F.upper(name)).otherwise(name).alias("name"))
    return named.select("name", arc.archive_type(F.col("name")).alias("kind"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.configs(spark, sf_dir, "archive", "member", "content")


def _archives(spark: SparkSession, sf_dir: str, fmt: str, name: Column | None = None) -> DataFrame:
    packed = arc.repack_archives(_members(spark, sf_dir), fmt)
    return packed.select((F.col("archive") if name is None else name).alias("path"), "content")


def _roundtrip_query(fmt: str) -> Query:
    def run(spark, sf_dir):
        plain = F.concat(F.regexp_replace("archive", r"\.zip$", ""), F.lit(f".{fmt}"))
        opened = arc.expand_archives(_archives(spark, sf_dir, fmt, plain))
        return opened.select("archive", "member", "size", F.md5("content").alias("digest"), "error")

    run.__name__ = "roundtrip_" + fmt.replace(".", "_")
    return run


for _fmt in ("zip", "tar", "tar.gz", "tar.bz2", "tar.xz"):
    query(_roundtrip_query(_fmt))


@query
def roundtrip_volumes(spark, sf_dir):
    """Archives cut into volumes hold every member exactly once."""
    packed = arc.repack_archives(_members(spark, sf_dir), "zip", volume_bytes=16_000)
    named = packed.select(F.concat_ws("#", "archive", "volume").alias("path"), "content").withColumn(
        "path", F.concat("path", F.lit(".zip")))
    opened = arc.expand_archives(named)
    return opened.select(F.substring_index("archive", "#", 1).alias("archive"), "member", "size", F.md5("content").alias("digest"))


@query
def roundtrip_flat(spark, sf_dir):
    """Members packed without their folders."""
    packed = arc.repack_archives(_members(spark, sf_dir), "zip", preserve_structure=False)
    opened = arc.expand_archives(packed.select(F.col("archive").alias("path"), "content"))
    return opened.select("archive", "member", "size", F.md5("content").alias("digest"))


@query
def archive_types_by_content(spark, sf_dir):
    """Types by leading bytes: packed archives under a name without a suffix."""
    bare = F.concat(F.lit("bare/"), F.regexp_replace("archive", r"\.zip$", ""))
    kinds = [
        _archives(spark, sf_dir, fmt, bare).select("path", F.lit(fmt).alias("packed_as"), arc.archive_type(F.col("path"), F.col("content")).alias("kind"))
        for fmt in ("zip", "tar", "tar.gz", "tar.bz2", "tar.xz")
    ]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out


@query
def refused_archives(spark, sf_dir):
    """Unsupported, unknown and broken archives become error rows."""
    bad = fx.configs(spark, sf_dir, "archive", "filename", "content")
    kind = F.when(F.endswith("filename", F.lit(".CFG")), ".7z").when(F.endswith("filename", F.lit(".txt")), ".zip").otherwise("")
    rows = bad.select(F.concat(F.col("filename"), kind).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return arc.expand_archives(rows).select("archive", F.split("error", ":")[0].alias("error"))


@query
def archive_errors(spark, sf_dir):
    """Error messages of archives that could not be opened, by base name."""
    bad = fx.configs(spark, sf_dir, "path", "content")
    rows = bad.select(F.concat("path", F.lit(".rar")).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return arc.archive_errors(arc.expand_archives(rows))


@query
def expand_compressed_files(spark, sf_dir):
    """Every configuration line written to gzip and bzip2 files, found by suffix, inflated and counted again."""
    lines = fx.configs(spark, sf_dir, "archive", "content").select(
        "archive", F.explode(F.split(F.regexp_replace("content", "\n\\z", ""), "\n")).alias("value"))
    found = None
    for codec in ("gzip", "bzip2"):
        out = new_dir(spark, codec)
        lines.write.partitionBy("archive").option("compression", codec).text(out)
        members = arc.expand_archives(src.scan_archives(spark, out)).withColumn("codec", F.lit(codec))
        found = members if found is None else found.unionByName(members)
    text = tx.decode_text(F.col("content"))
    again = found.select("codec", F.explode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n")).alias("line"))
    return again.groupBy("codec", "line").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_info(spark, sf_dir):
    info = arc.archive_info(arc.expand_archives(_archives(spark, sf_dir, "zip")))
    return info.select("archive", "total_files", "config_files", "size_mb", "encrypted")


@query
def archive_members(spark, sf_dir):
    """The ordered list of the members of each archive."""
    rows = arc.archive_members(arc.expand_archives(_archives(spark, sf_dir, "zip")))
    return rows.select("archive", "position", "members", "member", "is_config")


@query
def archive_config_files(spark, sf_dir):
    """The ordered list of its configuration files."""
    plain = arc.expand_archives(_archives(spark, sf_dir, "zip")).withColumn("member", F.regexp_replace("member", "^cfg/", "data/"))
    return arc.archive_members(plain, only_config=True).select("archive", "position", "members", "member")


@query
def sanitize_archives(spark, sf_dir):
    """Expand, sanitize the configuration members, pass the others through, pack, expand again."""
    members = arc.expand_archives(_archives(spark, sf_dir, "zip")).withColumn(
        "member", F.regexp_replace("member", "^cfg/", "data/"))
    # Packing reads the members twice, for their sizes and their bytes: written once.
    done = materialized(arc.sanitize_members(members).select("archive", "member", "size", F.col("output").alias("content")), "members")
    packed = arc.repack_archives(done, "tar.gz").select(F.concat("archive", F.lit(".tar.gz")).alias("path"), "content")
    return arc.expand_archives(packed).select("archive", "member", F.decode("content", "UTF-8").alias("content"))


@query
def archive_result(spark, sf_dir):
    members = arc.expand_archives(_archives(spark, sf_dir, "zip"))
    return arc.archive_result(arc.sanitize_members(members))


@query
def name_clashes(spark, sf_dir):
    """Members of two folders with the same base names."""
    rows = _members(spark, sf_dir).select("archive", "member")
    twice = rows.unionByName(rows.withColumn("member", F.concat(F.lit("old/"), "member")))
    return arc.name_clashes(twice)


@query
def member_preview(spark, sf_dir):
    return arc.member_preview(_members(spark, sf_dir)).select("archive", "member", _long("position"))


@query
def decode_documents(spark, sf_dir):
    """The documents' bytes, each behind an invalid byte and with CRLF line ends, as clean text."""
    rows = fx.raw_text(spark, sf_dir, "documents")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    return rows.select("id", tx.decode_text(raw).alias("content"), F.length(tx.decode_text(raw, normalize_newlines=False)).cast("bigint").alias("kept"))


@query
def scan_written_files(spark, sf_dir):
    """Write every configuration as a file of its own, then scan the folder."""
    out = new_dir(spark, "files")
    fx.written_configs(spark, sf_dir, out)
    files = src.scan_configs(spark, out, include_empty=False)
    return files.select(F.regexp_extract("path", fx.WRITTEN_NAME, 1).alias("filename"), "content")


def _files_in_cases(spark: SparkSession, sf_dir: str) -> str:
    """Every configuration as a file of its own, with suffixes in several cases, some empty and some of no known suffix."""
    key = F.col("c_custkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in FILE_CASES]), (key % len(FILE_CASES) + 1).cast("int"))
    name = F.concat(F.lit("site-"), (key % 7).cast("string"), F.lit("/deep/R-"), key.cast("string"), suffix)
    text = F.when(key % 10 == 9, F.lit("")).otherwise(F.expr(fx.CONFIG_TEXT))
    customers = fx.table(spark, sf_dir, "customer")
    keys = dealt(customers.select("c_custkey", "c_nationkey", "c_name"), customers.count())
    rows = keys.select(name.alias("name"), F.encode(text, "UTF-8").alias("body"))
    out = new_dir(spark, "folder")
    write_bodies(rows, out)
    return out


FILE_CASES = (".CFG", ".Cfg", ".cfg", ".txt", ".Conf", ".log", ".cFG")


@query
def scan_folder(spark, sf_dir):
    """A folder scan: suffixes in known cases, empty files too, nothing else."""
    files = src.scan_configs(spark, _files_in_cases(spark, sf_dir))
    return files.select("filename", "content", "error")


@query
def sanitize_folder_dry(spark, sf_dir):
    """A dry run of the folder job, with a requested file that isn't there."""
    folder = _files_in_cases(spark, sf_dir)
    absent = spark.createDataFrame([("/no/such.cfg",)], "path string")
    rows = jobs.sanitize_folder(spark, folder, f"{folder}-out", requested=absent, dry_run=True)
    return rows.select(F.regexp_replace("file", "^.*/deep/", "").alias("file"), "modified", _joined("changes"), _long("change_count"), "error")


@query
def write_files(spark, sf_dir):
    """Sanitized files written one by one, and listed by the executors."""
    out = new_dir(spark, "files")
    sinks.write_files(_run(spark, sf_dir), out, root="/configs")
    listed = list_folder(spark, out)
    return listed.select(F.regexp_extract("path", "/(site-[^/]*/[^/]*)$", 1).alias("name"), "length")


@query
def write_sanitized(spark, sf_dir):
    out = new_dir(spark, "sanitized")
    sinks.write_sanitized(_run(spark, sf_dir), out)
    return spark.read.parquet(out).select("path", "content", "modified")


# Backups ----------------------------------------------------------------------------


@query
def append_backup(spark, sf_dir):
    table = new_dir(spark, "backups")
    rows = fx.configs(spark, sf_dir, "path", "content")
    for day in (NOW.replace(day=30), NOW):
        bak.append_backup(rows, table, "/backups", day)
    return bak.read_catalog(spark, table).select(*bak.CATALOG, F.col("backup_date").cast("string").alias("backup_date"))


@query
def latest_backup(spark, sf_dir):
    return bak.latest_backup(fx.backups(spark, sf_dir))


@query
def asof_backup(spark, sf_dir):
    return bak.latest_backup(fx.backups(spark, sf_dir), "20240115")


@query
def restore_files(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/configs/click/R-"), F.col("c_custkey").cast("string"), F.lit(".conf")).alias("path"))
    return bak.restore_files(wanted, fx.backups(spark, sf_dir))


@query
def restore_contents(spark, sf_dir):
    """Files saved on two days, changed in between, and their contents restored as of the first day."""
    table = new_dir(spark, "backups")
    rows = fx.configs(spark, sf_dir, "path", "content")
    bak.append_backup(rows, table, "/backups", NOW.replace(day=30))
    bak.append_backup(rows.withColumn("content", F.concat("content", F.lit("! changed\n"))), table, "/backups", NOW)
    wanted, catalog = _requested(spark, sf_dir), bak.read_catalog(spark, table)
    days = [bak.restore_files(wanted, catalog, day).withColumn("day", F.lit(day)) for day in ("20240130", "2024")]
    return days[0].unionByName(days[1]).select("day", "path", "timestamp", "restored", F.md5("content").alias("digest"))


@query
def restore_directory(spark, sf_dir):
    folders = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("/configs/"), "event_type", F.lit("/")).alias("directory")).distinct()
    folders = folders.unionByName(folders.select(F.lit("/").alias("directory")))
    return bak.restore_directory(folders, fx.backups(spark, sf_dir))


@query
def list_backups(spark, sf_dir):
    return bak.list_backups(fx.backups(spark, sf_dir))


@query
def list_backups_of_file(spark, sf_dir):
    return bak.list_backups(fx.backups(spark, sf_dir), "/configs/click/R-7.conf")


@query
def retained_backups(spark, sf_dir):
    return bak.retained(fx.backups(spark, sf_dir), NOW, RETENTION_DAYS).select("backup_path", "timestamp")


@query
def expired_backups(spark, sf_dir):
    return bak.expired(fx.backups(spark, sf_dir), NOW, RETENTION_DAYS).select("backup_path", "timestamp")


@query
def cleanup_backups(spark, sf_dir):
    """Every snapshot written to a table by day, the expired ones removed, the table read again."""
    table = new_dir(spark, "backups")
    day = F.date_format(F.to_timestamp("timestamp", "yyyyMMdd_HHmmss"), "yyyy-MM-dd")
    rows = fx.backups(spark, sf_dir).withColumn("backup_date", day)
    rows.repartition("backup_date").write.partitionBy("backup_date").parquet(table)
    bak.drop_expired(spark, table, NOW, RETENTION_DAYS)
    return bak.read_catalog(spark, table).select("backup_path", "timestamp")


@query
def backup_stats(spark, sf_dir):
    return bak.backup_stats(fx.backups(spark, sf_dir))


# Hashes, logs, streams --------------------------------------------------------------


@query
def token_hash(spark, sf_dir):
    """A pseudonym per distinct community string of the corpus, from its number in value order."""
    found = det.detect_secrets(fx.configs(spark, sf_dir), ["path"], packs.LIBRARY.subset(["snmp_community"]), shown=None)
    values = numbered(found.select("value").distinct(), [], [F.col("value")])
    return values.select("value", tx.token_hash(F.lit("snmp"), F.col("idx")).alias("token"))


@query
def content_hash(spark, sf_dir):
    return fx.raw_text(spark, sf_dir, "documents").select(
        "id", tx.content_hash(F.col("content")).alias("digest"), tx.content_hash(F.col("content"), 8).alias("short"))


@query
def redact_logs(spark, sf_dir):
    return fx.logs(spark, sf_dir).select("event_id", redact_log(F.col("message")).alias("message"))


@query
def redact_log_stream(spark, sf_dir):
    stream = st.redact_log_stream(fx.log_stream_source(spark, sf_dir))
    return st.run_to_table(stream, new_dir(spark, "logs"), new_dir(spark, "checkpoint"))


@query
def sanitize_stream(spark, sf_dir):
    done = st.sanitize_stream(fx.config_stream_source(spark, sf_dir)).select("path", "sanitized", "modified", "change_count", "changes")
    return _rewritten(st.run_to_table(done, new_dir(spark, "stream"), new_dir(spark, "checkpoint")))


@query
def sanitize_dropped_files(spark, sf_dir):
    """Every configuration dropped into a folder as a file of its own, taken up by the folder's stream and sanitized."""
    folder = new_dir(spark, "drop")
    fx.written_configs(spark, sf_dir, folder)
    done = st.sanitize_stream(st.config_stream(spark, folder)).select("path", "sanitized", "modified", "change_count")
    table = st.run_to_table(done, new_dir(spark, "stream"), new_dir(spark, "checkpoint"))
    return table.select(F.regexp_extract("path", fx.WRITTEN_NAME, 1).alias("filename"), "sanitized", "modified", _long("change_count"))


LONG_FILE = 2000


@query
def dropped_file_errors(spark, sf_dir):
    """A drop folder with files above the length limit: the stream goes on, and they are dead letters."""
    stream = st.config_stream(spark, _files_in_cases(spark, sf_dir), max_length=LONG_FILE)
    done = st.sanitize_stream(stream).select("filename", "sanitized", "error")
    rows, dead = st.run_with_errors(done, new_dir(spark, "stream"), new_dir(spark, "checkpoint"))
    return rows.withColumn("table", F.lit("rows")).unionByName(dead.withColumn("table", F.lit("dead")))


@query
def findings_stream_batches(spark, sf_dir):
    """Running totals over several batches that hold equal file names."""
    folder, schema = new_dir(spark, "arriving"), fx.table(spark, sf_dir, "customer").schema
    fx.table(spark, sf_dir, "customer").repartition(5, "c_nationkey").write.parquet(folder)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    name = F.concat(F.lit("R-"), (F.col("c_custkey") % 40).cast("string"), F.lit(".conf"))
    keys = dealt(rows, fx.table(spark, sf_dir, "customer").count() // 5)
    configs = keys.select(F.expr(fx.CONFIG_COLUMNS["path"]).alias("path"), name.alias("filename"), F.expr(fx.CONFIG_TEXT).alias("content"))
    totals = st.findings_rollup(st.sanitize_stream(configs))
    return st.run_rollup(totals, new_dir(spark, "rollup"), new_dir(spark, "checkpoint"))


@query
def findings_stream(spark, sf_dir):
    totals = st.findings_rollup(st.sanitize_stream(fx.config_stream_source(spark, sf_dir)))
    return st.run_rollup(totals, new_dir(spark, "rollup"), new_dir(spark, "checkpoint"))
