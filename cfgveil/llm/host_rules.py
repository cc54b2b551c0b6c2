"""Quality rules per document and per host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.tables import join_checked, stored
from cfgveil.operators.chain import pinned

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Rules a host is judged by: share of its documents that fail.
RULES = ("short", "repetitive", "symbols", "lines", "word_length")


def document_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    No text is exploded or shuffled. Words in repeated three-word windows are found in the
    row: windows are hashed, rows without two equal hashes are done, and for the others the
    sorted (hash, position) pairs give the repeated positions, whose cover is a gap sum.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = keep or []
    lines = F.filter(F.split(F.col("body"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = pinned(df.select(*keep, body.alias("body")), [*keep, "body"], {
        "words": F.filter(F.split(F.col("body"), SPACE), lambda w: w != ""),
        "lines": lines,
    })
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(*[F.get(F.col("words"), i + d) for d in (-1, 0, 1)])),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = pinned(words, keep, {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": windows,
    })
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    paired = F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    paired = pinned(counted, [c for c in counted.columns if c != "windows"], {"paired": paired})
    n = F.size("paired")
    repeated = F.filter(
        F.col("paired"),
        lambda x, j: ((j > 0) & (F.get(F.col("paired"), F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
        | ((j < n - 1) & (F.get(F.col("paired"), F.least(j + 1, n - 1))["h"] == x["h"])),
    )
    rest = [c for c in counted.columns if c != "windows"]
    placed = pinned(paired, rest, {"at": F.sort_array(F.transform(repeated, lambda x: x["i"]))})
    covered = F.aggregate(
        "at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return placed.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """Whether a document fails each rule; the first two are the base rules."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * F.greatest(chars, F.lit(1).cast("long")),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.greatest(n / 10, F.lit(1.0)),
        "word_length": (chars > 15 * n) | (chars < 2 * n),
    }


def host_verdicts(stats: DataFrame, host: str, deviations: float = 1.0) -> DataFrame:
    """(host, n_docs, rate_<rule>..., rejected): shrunk failure rates of every host.

    Each rule's rates over hosts give a beta prior by the method of moments (mean and
    variance of the rates, hosts counted alike); a host's rate is its posterior mean, so a
    host with few documents stays near the others. A host is rejected if some rule's shrunk rate
    lies more than `deviations` of its posterior standard deviations above the mean of the
    hosts (one: the host is worse than the corpus with a probability of about 0.84). Rates
    without spread (one host, or all alike) take a prior of the mean that weighs as much as
    100 documents.
    """
    fails = failures()
    counts = stats.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(fails[r].cast("long")).alias(f"k_{r}") for r in RULES])
    rate = {r: F.col(f"k_{r}") / F.col("n_docs") for r in RULES}
    prior = counts.agg(*[f.alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg(rate[r])), ("v", F.var_pop(rate[r])))])
    joined = counts.crossJoin(F.broadcast(prior))  # one row
    worse = F.lit(False)
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when((v > 0) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(F.lit(100.0))
        shrunk, above = (F.col(f"k_{r}") + m * weight) / (F.col("n_docs") + weight), F.col(f"rate_{r}") - m
        joined = joined.withColumns({f"rate_{r}": shrunk, f"weight_{r}": weight})
        spread = F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}"))
        worse = worse | ((above > 0) & (above * above * (F.col("n_docs") + F.col(f"weight_{r}") + 1) > deviations * deviations * spread))
    return joined.select(host, "n_docs", *[f"rate_{r}" for r in RULES], worse.alias("rejected"))


def quality(df: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", *, deviations: float = 1.0) -> DataFrame:
    """Judge every document by its own text and by its host.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    host_rejected, kept), one row for each row of `df`. A document goes if it fails a base
    rule (fewer than 50 words; over half of its words in repeated three-word windows), or if
    its host is rejected and it fails any of the other rules. A rejected host's documents
    that pass every rule stay.

    The statistics are written once, narrow; hosts are counted with partial sums, so a host
    with a third of all rows is no burden. A null host is a host of its own, a null text has
    no words, equal ids are judged row by row. An empty table gives an empty table.
    """
    kept = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    stats, _ = stored(document_stats(kept, "text", ["id", "host"]), "stats")
    hosts, _ = stored(host_verdicts(stats, "host", deviations).select(F.col("host").alias("of"), F.col("rejected")), "hosts")
    judged = join_checked(stats, hosts, {"host": "of"}, "left", 100)
    fails = failures()
    base = fails["short"] | fails["repetitive"]
    soft = fails["symbols"] | fails["lines"] | fails["word_length"]
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    return judged.select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), rejected.alias("host_rejected"), (~base & ~(rejected & soft)).alias("kept"),
    )


def keep_good(df: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `df`, all columns, without the ids that `quality` rejects.

    A row with a null id is judged like any other; rows that share an id stay or go together
    (they go if any of them is rejected).
    """
    bad, _ = stored(quality(df, id, text, host).where(~F.col("kept")).select(F.col(id).alias("__bad")).distinct(), "rejected")
    return join_checked(df, bad, {id: "__bad"}, "left_anti", 16) if bad.count() else df

