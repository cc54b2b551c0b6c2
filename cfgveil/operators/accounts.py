"""Accounts: lines that name them, pseudonyms per file, membership and occurrences."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cfgveil.operators import occurrences as occ
from cfgveil.operators.chain import Chain, pinned
from cfgveil.rules import Rule, any_of, odd_folding
from cfgveil.session import join_lookup

ACCOUNT_SCHEMA = "username string, kind string, ordinal int"
ALIAS_PREFIX = "netadmin"

# Up to this many names are unrolled into expressions in generated code; longer lists are
# one array literal (`sanitize`) or a table that is joined (`rename_accounts`), with equal rows.
INLINE_ACCOUNTS = 512


def accounts_frame(
    spark: SparkSession, personal: Sequence[str] = (), service: Sequence[str] = ()
) -> DataFrame:
    """Account names of a rule pack as a table; personal names keep their declared order."""
    rows = [(u, "personal", i) for i, u in enumerate(dict.fromkeys(personal), 1)]
    rows += [(u, "service", i) for i, u in enumerate(dict.fromkeys(service), 1)]
    return spark.createDataFrame(rows, ACCOUNT_SCHEMA)


def merge_accounts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two account tables by name and kind; the lower ordinal wins."""
    both = left.select("username", "kind", "ordinal").unionByName(right.select("username", "kind", "ordinal"))
    return both.groupBy("username", "kind").agg(F.min("ordinal").alias("ordinal"))


def _names_json(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _names(values: Sequence[str]) -> Column:
    if len(values) > INLINE_ACCOUNTS:
        return _names_json(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# In-row form ------------------------------------------------------------------------


def users_on_lines(text: Column, user_rule: Rule) -> Column:
    """User names on the lines the user rule matches, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(user_rule.java()), F.lit(2)))


def personal_on_lines(text: Column, user_rule: Rule, personal: Column, service: Column) -> Column:
    found = users_on_lines(text, user_rule)
    return F.filter(
        found, lambda u: F.array_contains(personal, u) & ~F.array_contains(service, u)
    )


def rename_on_lines(text: Column, names: Column) -> Column:
    """Replace each name, as a whole user field, on the user lines already rewritten."""
    tail = r"\E(?=(?: .*)?(?:secret|password) (?:\d+ )?<removed-user-secret>$)"
    start = F.lit(r"(?dUm)^([^\S\n]*username )\Q")
    return F.aggregate(
        names,
        text,
        lambda acc, name: F.regexp_replace(
            acc,
            F.concat(start, name, F.lit(tail)),
            F.concat(F.lit("$1" + ALIAS_PREFIX), F.array_position(names, name).cast("string")),
        ),
    )


RENAME_TYPE = "struct<text:string,names:array<string>,hits:array<struct<username:string,alias:string,n:bigint>>>"


def renamed(text: Column, known: Column, candidates: Column) -> Column:
    """Fold the candidates over a text: every occurrence of a name becomes its pseudonym.

    `known` holds the names that already have a number (from user lines), in order; a new
    name takes the next number. Returns struct<text, names, hits>.
    """
    start = F.struct(
        text.alias("text"),
        known.alias("names"),
        F.array().cast("array<struct<username:string,alias:string,n:bigint>>").alias("hits"),
    ).cast(RENAME_TYPE)

    def step(acc: Column, name: Column) -> Column:
        names = F.when(F.array_contains(acc["names"], name), acc["names"]).otherwise(
            F.array_append(acc["names"], name)
        )
        alias = F.concat(F.lit(ALIAS_PREFIX), F.array_position(names, name).cast("string"))
        hit = F.struct(
            name.alias("username"), alias.alias("alias"), occurrences(acc["text"], name).alias("n")
        )
        return F.when(
            F.contains(acc["text"], name),
            F.struct(
                F.replace(acc["text"], name, alias).alias("text"),
                names.alias("names"),
                F.array_append(acc["hits"], hit).alias("hits"),
            ).cast(RENAME_TYPE),
        ).otherwise(acc)

    return F.aggregate(candidates, start, step)


def occurrences(text: Column, name: Column) -> Column:
    """Number of non-overlapping occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("bigint")


def contained(text: Column, personal: Sequence[str]) -> Column:
    """The personal names a text holds, in declared order."""
    if len(personal) > INLINE_ACCOUNTS:
        return F.filter(_names(personal), lambda u: F.contains(text, u))
    return F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(u)), F.lit(u)) for u in personal])
    )


def rename_messages(hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.concat(
            F.lit("Username "), h["username"], F.lit(" -> "), h["alias"],
            F.lit(" ("), h["n"].cast("string"), F.lit(" occurrences)"),
        ),
    )


# User lines as the user rule leaves them.
SANITIZED_USER_LINE = r"(?dUm)^[^\S\n]*username (\S+)(?=(?: .*)?(?:secret|password) (?:\d+ )?<removed-user-secret>$)"


def rename_accounts(
    df: DataFrame, accounts: DataFrame, *, content: str = "content", key: str = "path", user_lines: bool = False
) -> DataFrame:
    """Replace personal account names in a corpus by per-file pseudonyms.

    Adds `renamed` and `hits`. Short account lists are unrolled into each row; longer ones are
    an automaton that reads each text in its place; for lists beyond that the names of each
    text are found through a bitmap of hashes and joined to it. All ways give the same rows. With `user_lines` the texts are sanitized ones: personal users of their
    user lines that are no service accounts are numbered first and renamed as whole names,
    as `sanitize` does for account lists that fit into its expressions. (Only a name that
    is itself part of a pseudonym, such as `admin`, can differ: here a name counts when
    the text holds it before any renaming.)
    """
    service = accounts.filter(F.col("kind") == "service").select("username").distinct().withColumn("serves", F.lit(True))
    personal = (
        accounts.filter(F.col("kind") == "personal")
        .join(service, "username", "left")
        .select("username", "ordinal", F.coalesce("serves", F.lit(False)).alias("serves"))
    )
    few = personal.orderBy("ordinal", "username").limit(INLINE_ACCOUNTS + 1).collect()
    none = F.array().cast("array<string>")
    if len(few) <= INLINE_ACCOUNTS:
        on_lines = _names([r["username"] for r in few if not r["serves"]])
        found = df.withColumns({"__found": contained(F.col(content), [r["username"] for r in few]), "__lines": on_lines})
    elif (personal.agg(F.sum(F.length("username"))).first()[0] or 0) <= occ.AUTOMATON_CHARS:
        every = personal.where("length(username) > 0").orderBy("ordinal", "username", "serves").collect()
        found = _held(df, content, [(r["username"], r["serves"]) for r in every])
    else:
        pairs = occurring_accounts(df, personal.select("username", "ordinal"), content=content, key=key)
        flagged = pairs.join(personal.select("username", "serves").distinct(), "username")
        per_file = flagged.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "username", "serves"))).alias("__pairs")
        )
        found = (
            join_lookup(df, per_file, key, "left")
            .withColumn("__found", F.coalesce(F.col("__pairs.username"), none))
            .withColumn("__lines", F.coalesce(F.filter("__pairs", lambda p: ~p["serves"])["username"], none))
            .drop("__pairs")
        )
    if user_lines:
        users = F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(SANITIZED_USER_LINE), F.lit(1)))
        known = F.when(F.contains(F.col(content), F.lit("username ")), F.array_intersect(users, F.col("__lines"))).otherwise(none)
    else:
        known = none
    started = found.withColumn("__known", known).withColumn(
        "__start", F.when(F.size("__known") > 0, rename_on_lines(F.col(content), F.col("__known"))).otherwise(F.col(content))
    )
    fold = renamed(F.col("__start"), F.col("__known"), F.col("__found"))
    folded = started.withColumn("__fold", F.when(F.size("__found") > 0, fold))
    empty = F.array().cast("array<struct<username:string,alias:string,n:bigint>>")
    return pinned(
        folded,
        df.columns,
        {
            "renamed": F.coalesce(F.col("__fold.text"), F.col("__start")),
            "hits": F.coalesce(F.col("__fold.hits"), empty),
        },
    )


# Join forms, for account tables of any size -------------------------------------------


def occurring_accounts(
    df: DataFrame, accounts: DataFrame, *, content: str = "content", key: str = "path"
) -> DataFrame:
    """(key, username, ordinal, n): which accounts occur as substrings, and how often.

    The texts are read once and never joined (see `literal_counts`).
    """
    counts = occ.literal_counts(df, accounts.select(F.col("username").alias("literal")), content=content, key=key)
    named = join_lookup(counts, accounts.select(F.col("username").alias("literal"), "ordinal").distinct(), "literal")
    return named.select(key, F.col("literal").alias("username"), "ordinal", "n")


def _held(df: DataFrame, content: str, accounts: list[tuple[str, bool]]) -> DataFrame:
    """`__found`, the names each text holds, and `__lines`, those that serve nothing, both in the order given."""
    names = list(dict.fromkeys(u for u, _ in accounts))
    place: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(accounts):
        place.setdefault(name, []).append(k)
    places = F.from_json(F.lit(json.dumps([place[n] for n in names])), "array<array<int>>")
    listed, serves = _names_json([u for u, _ in accounts]), F.from_json(F.lit(json.dumps([s for _, s in accounts])), "array<boolean>")
    counted = df.withColumn("__hits", occ.counted_literals(F.col(content), names)["literal"])
    order = F.array_sort(F.flatten(F.transform("__hits", lambda k: F.get(places, k))))
    ordered = counted.withColumn("__hits", F.when(F.size("__hits") > 0, order).otherwise(F.array().cast("array<int>")))
    lines = F.filter("__hits", lambda k: ~F.get(serves, k))
    found = {"__found": F.transform("__hits", lambda k: F.get(listed, k)), "__lines": F.transform(lines, lambda k: F.get(listed, k))}
    return ordered.withColumns(found).drop("__hits")


def account_occurrences(df: DataFrame, accounts: DataFrame, *, content: str = "content", key: str = "path") -> DataFrame:
    """Total occurrences and number of files per personal account that occurs at all."""
    personal = accounts.filter(F.col("kind") == "personal").select("username", "ordinal")
    return (
        occurring_accounts(df, personal, content=content, key=key)
        .groupBy("username")
        .agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))
    )


def username_lines(df: DataFrame, user_rule: Rule, *, content: str = "content", key: str = "path") -> DataFrame:
    """One row per line the user rule matches: (key, line_no, username, line)."""
    matched = F.col("line").rlike(user_rule.java())
    return (
        df.filter(F.contains(F.col(content), F.lit("username ")))
        .select(key, F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"))
        .filter(F.contains("line", F.lit("username ")) & matched)
        .select(
            key,
            (F.col("pos") + 1).alias("line_no"),
            F.regexp_extract("line", user_rule.java(), 2).alias("username"),
            "line",
        )
    )


def members_of(lines: DataFrame, accounts: DataFrame, kind: str) -> DataFrame:
    """The user lines whose user is an account of this kind."""
    wanted = accounts.filter(F.col("kind") == kind).select("username")
    return lines.join(wanted, "username", "left_semi")


def pseudonyms(lines: DataFrame, accounts: DataFrame, *, key: str = "path") -> DataFrame:
    """(key, username, alias): personal users numbered per file by first appearance.

    Lines are reduced to one row per file and user before anything is ranked.
    """
    personal = members_of(lines, accounts, "personal")
    service = accounts.filter(F.col("kind") == "service").select("username")
    first = (
        personal.join(service, "username", "left_anti")
        .groupBy(key, "username")
        .agg(F.min("line_no").alias("first_line"))
    )
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("first_line", "username"))
    return first.withColumn("alias", F.concat(F.lit(ALIAS_PREFIX), rank.cast("string")))


BLOCK_KEY = "struct<service:string,block:string,line_no:int,key_type:string,secret:string>"


def server_block_keys(df: DataFrame, services: str | Sequence[str], *, content: str = "content", key: str = "path") -> DataFrame:
    """(key, service, block, line_no, key_type, secret): the first typed key of each `<service> server` block.

    An indented line belongs to the last header above it unless an unindented line closed the
    block. Each text is folded line by line in its row: the state is the open block of every
    service and the keys so far; nothing is shuffled.
    """
    services = [services] if isinstance(services, str) else list(services)
    text = F.col(content)
    wanted = F.lower(text)
    some = df.filter(any_of([F.contains(wanted, F.lit(f"{s} server ")) for s in services]))
    lines = F.split(text, "\n")
    block = "struct<title:string,open:boolean>"
    start = F.struct(
        F.lit(0).alias("at"),
        F.array(*[F.struct(F.lit(""), F.lit(False)) for _ in services]).cast(f"array<{block}>").alias("blocks"),
        F.array().cast(f"array<{BLOCK_KEY}>").alias("keys"),
    )
    typed = r"(?diU)^[ \t]+key (\d+) (\S+)"

    def step(state: Column, line: Column) -> Column:
        at, low = state["at"] + 1, F.lower(line)
        indented, hit = line.rlike(r"^[ \t]"), line.rlike(typed)
        moved, found = [], []
        for k, service in enumerate(services):
            now = state["blocks"][k]
            opens = line.rlike(rf"(?di)^(?:\S.*)?{service} server .|^[ \t]{service} server .")
            title = F.regexp_extract(line, rf"(?diU)^.*?{service} server (.+)$", 1)
            shut = F.struct(now["title"], F.lit(False)).cast(block)  # by an unindented line, or as its later keys don't count
            moved.append(F.when(opens, F.struct(title, F.lit(True)).cast(block)).when(~indented | hit, shut).otherwise(now))
            one = F.struct(F.lit(service), now["title"], at, F.regexp_extract(line, typed, 1), F.regexp_extract(line, typed, 2)).cast(BLOCK_KEY)
            found.append(F.when(now["open"] & ~opens & hit, one))
        keys = F.when(hit, F.concat(state["keys"], F.array_compact(F.array(*found)))).otherwise(state["keys"])
        # Most lines can't change the state; they cost a few cheap tests.
        idle = indented & ~F.contains(low, F.lit("key ")) & ~F.contains(low, F.lit(" server ")) & ~odd_folding(line)
        same = F.struct(at.alias("at"), state["blocks"].alias("blocks"), state["keys"].alias("keys"))
        return F.when(idle, same).otherwise(F.struct(at.alias("at"), F.array(*moved).alias("blocks"), keys.alias("keys")))

    found = F.aggregate(lines, start, step, lambda s: s["keys"])
    return some.select(F.col(key), F.inline(found))


def rename_step(chain: Chain, user_rule: Rule, before: str, personal: Sequence[str], service: Sequence[str]) -> Chain:
    """After the user rule: number the personal users of its lines and rename them there."""
    names = personal_on_lines(F.col(before), user_rule, _names(personal), _names(service))
    count = chain.counts[-1][1]
    df = chain.df.withColumn(
        "__line_names", F.when(F.col(count) > 0, names).otherwise(F.array().cast("array<string>"))
    )
    return Chain(df, chain.text, chain.counts).with_text(
        F.when(F.size("__line_names") > 0, rename_on_lines(F.col(chain.text), F.col("__line_names")))
        .otherwise(F.col(chain.text))
    )
