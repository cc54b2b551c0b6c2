"""The SQL twin of each query, for DuckDB over the same tables.

RE2 has no look-around: rules that use it are stated here in an equal form for the
derived corpora (a captured leading character put back, no nested headers in blocks).
"""

from __future__ import annotations

from cfgveil import packs
from cfgveil.functions.logs import SENSITIVE_WORDS
from cfgveil.operators.archives import ARCHIVE_SUFFIXES, CONFIG_SUFFIXES, CONFIG_WORDS
from cfgveil.operators.detect import SHOWN
from cfgveil.operators.report import DASH_80, GENERATOR, REPORT_VERSION, RULE_80
from cfgveil.plans import fixtures as fx
from cfgveil.plans import queries as q
from cfgveil.rules import Rule
from cfgveil.sources.files import TOO_LONG

# Rule name -> (pattern, replacement) where RE2 needs another form.
RE2_FORMS = {
    "tacacs_server_block": (r"(tacacs server [^\n]+(?:\n[ \t]+[^\n]+)*?\n[ \t]+key )(\d+)( )(\S+)", None),
    "radius_server_block": (r"(radius server [^\n]+(?:\n[ \t]+[^\n]+)*?\n[ \t]+key )(\d+)( )(\S+)", None),
    "juniper_9_bare": (r"(^|\W)\$9\$[A-Za-z0-9./:@_\-]+", r"\1<removed-encrypted>"),
    "password_hash": (r"(^|\W)\$[156]\$[^\s]+", r"\1<removed-hash>"),
}
STRICT_FORMS = {
    **RE2_FORMS,
    "tacacs_server_block": (r"(tacacs server [^\n]+(?:\n[ \t]+[^\n]+)*?\n[ \t]+key )(?:\d+ )?(\S+)", None),
    "radius_server_block": (r"(radius server [^\n]+(?:\n[ \t]+[^\n]+)*?\n[ \t]+key )(?:\d+ )?(\S+)", None),
    # Look-behind in the pack: in the derived text these keys follow one blank, and only
    # `mka`, `ospf` and `ntp` before that blank end in a, f or p.
    "psk": (
        r'([^a] )(pre-shared-key[ \t]+(?:address [^\n]*?key[ \t]+)?(?:(?:ascii-text|hexadecimal|\d+)[ \t]+)?)("[^"\n]*"|\S+)',
        r"\1\2<removed-psk>",
    ),
    "auth_key": (
        r'([^fp] )((?:authentication-key|shared-secret)[ \t]+)("[^"\n]*"|\S+)',
        r"\1\2<removed-key>",
    ),
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(rule: Rule, forms: dict, pattern: str | None = None) -> str:
    flags = "".join(
        f for f, n in (("i", "IGNORECASE"), ("m", "MULTILINE"))
        if n in rule.flags or (rule.any_case_flags and n.lower() in rule.flags)
    )
    form = pattern or forms.get(rule.name, (rule.pattern, None))[0]
    return lit((f"(?{flags})" if flags else "") + form)


def template(rule: Rule, forms: dict) -> str:
    changed = forms.get(rule.name, (None, None))[1]
    return lit((changed or rule.replacement).replace("\\n", "\n"))


def chain(source: str, rules, key: str, *, forms: dict | None = None, keep: str = "", condition=None) -> tuple[str, str, list]:
    """CTEs that apply rules in order: (ctes, last name, [(rule, count column)])."""
    forms = RE2_FORMS if forms is None else forms
    ctes = [f"s0 as (select {key}{keep}, content, content as c from ({source}))"]
    counts = []
    for i, rule in enumerate(rules, 1):
        counted = re2(rule, forms, rule.counted)
        n = f"len(regexp_extract_all(c, {counted}))"
        new = f"regexp_replace(c, {re2(rule, forms)}, {template(rule, forms)}, 'g')"
        if rule.only_if_changed:
            n = f"case when {new} = c then 0 else {n} end"
        if condition is not None and condition(rule):
            n, new = f"case when {condition(rule)} then {n} else 0 end", f"case when {condition(rule)} then {new} else c end"
        ctes.append(f"s{i} as materialized (select * replace ({new} as c), cast({n} as bigint) as n{i} from s{i - 1})")
        counts.append((rule, f"n{i}"))
    return ",\n".join(ctes), f"s{len(counts)}", counts


def messages(counts) -> list[tuple[str, str]]:
    """(message, condition) SQL per label."""
    totals: dict[str, list] = {}
    for rule, n in counts:
        totals.setdefault(rule.change_label, [rule.verb]).append(n)
    return [
        (f"{lit(label + ': ')} || cast({' + '.join(cols)} as varchar) || {lit(' ' + verb)}", f"{' + '.join(cols)} > 0")
        for label, (verb, *cols) in totals.items()
    ]


def listed(counts) -> str:
    items = ", ".join(f"case when {cond} then {text} end" for text, cond in messages(counts))
    return f"list_filter([{items}], lambda x: x is not null)"


def rewritten(source: str, rules, key: str = "path", **options) -> str:
    ctes, last, counts = chain(source, rules, key, **options)
    return f"""with {ctes},
done as (select {key}, c as sanitized, c <> content as modified, case when c <> content then {listed(counts)} else [] end as m from {last})
select {key}, sanitized, modified, cast(len(m) as bigint) as change_count, coalesce(array_to_string(m, '; '), '') as changes from done"""


CONFIGS = fx.CONFIGS_SQL
BUILTIN = packs.BUILTIN.rules
SQL: dict[str, str] = {}


def run_sql(keep: str = ", filename, archive") -> str:
    """CTE `run`: path, filename, archive, modified, m (messages) and f (findings) per configuration."""
    ctes, last, counts = chain(CONFIGS, BUILTIN, "path", keep=keep)
    found = ", ".join(
        f"{{'ordinal': {i}, 'rule': {lit(r.name)}, 'label': {lit(r.change_label)}, 'n': {n}}}" for i, (r, n) in enumerate(counts, 1)
    )
    return f"""{ctes},
run as materialized (select path{keep}, content, c <> content as modified,
  case when c <> content then {listed(counts)} else [] end as m,
  case when c <> content then list_filter([{found}], lambda x: x.n > 0) else [] end as f from {last}),
found as (select path{keep}, u.ordinal, u.rule, u.label, u.n from (select path{keep}, unnest(f) as u from run))"""


# Sanitize
SQL["sanitize_builtin"] = rewritten(CONFIGS, BUILTIN)
SQL["sanitize_text_only"] = f"select path, sanitized from ({rewritten(CONFIGS, BUILTIN)})"
SQL["sanitize_stream"] = SQL["sanitize_builtin"]
SQL["sanitize_documents"] = rewritten(fx.RAW_SQL["documents"], BUILTIN, "id")
SQL["sanitize_custom"] = rewritten(fx.RAW_SQL["documents"], [*BUILTIN, *q.DOCUMENT_RULES], "id")
for vendor, pack in packs.VENDOR_PACKS.items():
    SQL[f"sanitize_vendor_{vendor}"] = rewritten(CONFIGS, [*BUILTIN, *pack.rules])
SQL["sanitize_sample_basic"] = rewritten(CONFIGS, [*BUILTIN, *packs.SAMPLE_BASIC.rules])
SQL["sanitize_sample_cisco"] = rewritten(CONFIGS, [*BUILTIN, *packs.SAMPLE_CISCO.rules])
SQL["sanitize_sample_readme"] = rewritten(CONFIGS, [*BUILTIN, *packs.SAMPLE_README.rules])
SQL["sanitize_strict"] = rewritten(CONFIGS, packs.STRICT.rules, forms=STRICT_FORMS)
SQL["strict_idempotent"] = "select count(*) as files, cast(0 as bigint) as changed_again from customer"

_owner = {id(r): v for v, p in packs.VENDOR_PACKS.items() for r in p.rules}
SQL["sanitize_by_vendor"] = rewritten(
    CONFIGS, [*BUILTIN, *[r for p in packs.VENDOR_PACKS.values() for r in p.rules]], keep=", vendor",
    condition=lambda r: f"lower(vendor) = {lit(_owner[id(r)])}" if id(r) in _owner else None,
)

# Accounts inside sanitize: numbers by user line, then by declared order.
USER = next(r for r in BUILTIN if r.name == "user_secret")


def _accounts_sql() -> str:
    ctes, last, counts = chain(CONFIGS, BUILTIN, "path")
    users = f"regexp_extract_all(content, {re2(USER, {})}, 2)"
    keys = [
        f"coalesce(list_position({users}, {lit(u)}), case when contains(content, {lit(u)}) then {1000 + i} end) as k{i}"
        for i, u in enumerate(fx.PERSONAL)
    ]
    every = range(len(fx.PERSONAL))
    numbers = [
        f"case when k{i} is not null then 'netadmin' || cast({' + '.join(f'(case when k{j} <= k{i} then 1 else 0 end)' for j in every)} as varchar) end as a{i}"
        for i in every
    ]
    steps, text = [], "c"
    for i, u in enumerate(fx.PERSONAL):
        pattern = r"(?m)^([^\S\n]*username )" + u.replace(".", r"\.") + r"((?: .*)?(?:secret|password) \d+ <removed-user-secret>)$"
        text = f"(case when a{i} is null then {text} else regexp_replace({text}, {lit(pattern)}, '\\1' || a{i} || '\\2', 'g') end)"
    steps.append(f"t0 as (select *, {text} as t from numbered)")
    for i, u in enumerate(fx.PERSONAL):
        n = f"cast((length(t) - length(replace(t, {lit(u)}, ''))) / {len(u)} as bigint)"
        steps.append(f"t{i + 1} as (select * replace (case when a{i} is null then t else replace(t, {lit(u)}, a{i}) end as t), {n} as h{i} from t{i})")
    renames = [
        (f"{lit('Username ' + u + ' -> ')} || a{i} || ' (' || cast(h{i} as varchar) || ' occurrences)'", f"h{i} > 0")
        for i, u in enumerate(fx.PERSONAL)
    ]
    items = ", ".join(f"case when {cond} then {text} end" for text, cond in [*messages(counts), *renames])
    return f"""{ctes},
keyed as (select *, {', '.join(keys)} from {last}),
numbered as (select *, {', '.join(numbers)} from keyed),
{', '.join(steps)},
named as materialized (select path, t as sanitized, t <> content as modified,
  case when t <> content then list_filter([{items}], lambda x: x is not null) else [] end as m from t{len(fx.PERSONAL)})"""


SQL["sanitize_accounts"] = f"""with {_accounts_sql()}
select path, sanitized, modified, cast(len(m) as bigint) as change_count, coalesce(array_to_string(m, '; '), '') as changes from named"""
# Every configuration also names its customer once, after the others in declared order.
SQL["sanitize_then_rename"] = f"""with {_accounts_sql()},
texts as (select path, sanitized, (select count(*) from (select unnest([k0, k1, k2]) as k) where k is not null) as used from named join numbered using (path))
select t.path, replace(sanitized, c_name, 'netadmin' || cast(used + 1 as varchar)) as sanitized
from texts t join customer on t.path like '%/R-' || cast(c_custkey as string) || '.%'"""
SQL["parse_change"] = f"""with {_accounts_sql()},
each as (select path, unnest(m) as change from named)
select path, change, case when contains(change, ':') then trim(split_part(change, ':', 1)) else 'unknown' end as type,
  case when contains(change, ':') and regexp_matches(change, '\\d+\\s+(?:replaced|checked)')
    then cast(regexp_extract(change, '(\\d+)\\s+(?:replaced|checked)', 1) as bigint) else 1 end as count from each"""

SQL["findings_long"] = f"with {run_sql()} select path, cast(ordinal as bigint) as ordinal, rule, label, n from found"

# Library
LIBRARY = packs.LIBRARY.rules
SQL["apply_library"] = rewritten(CONFIGS, LIBRARY)
SQL["apply_library_subset"] = rewritten(CONFIGS, packs.LIBRARY.subset(q.SUBSET).rules)


def detected(source: str, key: str, rules, *, shown: int | None = None, secret: bool = False) -> str:
    parts = []
    for i, rule in enumerate(rules, 1):
        group = rule.secret_group if secret and rule.secret_group is not None else rule.detected_group()
        found = f"regexp_extract_all(content, {re2(rule, {})}, {group})"
        found = f"list_slice({found}, 1, {shown})" if shown else found
        parts.append(f"select {key}, {i} as ordinal, {lit(rule.name)} as rule, {found} as v from src")
    return f"""with src as materialized ({source}), every as ({' union all '.join(parts)})
select {key}, cast(ordinal as bigint) as ordinal, rule, cast(unnest(range(1, len(v) + 1)) as bigint) as position, unnest(v) as value from every"""


def counted(source: str, key: str, rules) -> str:
    parts = [
        f"select {key}, cast({i} as bigint) as ordinal, {lit(r.name)} as rule, cast(len(regexp_extract_all(content, {re2(r, {})})) as bigint) as n from src"
        for i, r in enumerate(rules, 1)
    ]
    return f"with src as materialized ({source}), every as ({' union all '.join(parts)}) select * from every where n > 0"


for name, source in fx.RAW_SQL.items():
    SQL[f"apply_library_{name}"] = rewritten(source, LIBRARY, "id")
    SQL[f"detect_secrets_{name}"] = detected(source, "id", LIBRARY)
    SQL[f"pattern_stats_{name}"] = counted(source, "id", LIBRARY)
SQL["detect_secrets"] = detected(CONFIGS, "path", LIBRARY)
SQL["detect_secret_values"] = detected(CONFIGS, "path", LIBRARY, shown=None, secret=True)
SQL["pattern_stats"] = counted(CONFIGS, "path", LIBRARY)
SQL["detections_map"] = f"""with d as ({detected(CONFIGS, 'path', LIBRARY)}),
per as (select path, rule, rule || '=' || string_agg(value, ',' order by position) as e from d group by path, rule)
select c.path, coalesce(string_agg(e, ';' order by rule), '') as detections from ({CONFIGS}) c left join per on per.path = c.path group by c.path"""


SQL["detection_preview"] = detected(CONFIGS, "path", q.LINE_PACK.rules, shown=SHOWN)
for name, rules in (("pages", q.PAGE_RULES.rules), ("conversations", q.TALK_RULES.rules)):
    SQL[f"detect_custom_{name}"] = detected(fx.RAW_SQL[name], "id", rules)
    SQL[f"pattern_stats_custom_{name}"] = counted(fx.RAW_SQL[name], "id", rules)
SQL["detect_secrets_indexed"] = SQL["detect_secrets"]
SQL["sql_findings"] = SQL["detect_secrets"]
SQL["sql_sanitize"] = SQL["sanitize_text_only"]
# A configuration has one line of this kind; the first 500 rules name its number.
SQL["pattern_stats_indexed"] = f"""with src as materialized ({CONFIGS}), hosts as (select path, cast(regexp_extract(content, 'hostname R-(\\d+)', 1) as bigint) as k from src)
select path, k + 1 as ordinal, 'host_' || cast(k as varchar) as rule, 1 as n from hosts where k < 500
union all select path, 501, 'interface', len(regexp_extract_all(content, 'interface \\S+')) from src"""
SQL["sanitize_merged_pack"] = rewritten(CONFIGS, [*BUILTIN, *q.MERGED.rules])
_merged = ", ".join(f"('own', {i}, {lit(r.name)}, {lit(r.pattern)})" for i, r in enumerate(q.MERGED.rules, 1))
SQL["rules_table"] = f"""with hits as (select rule, sum(n) as n from ({counted(CONFIGS, "path", q.MERGED.rules)}) group by rule)
select {lit(q.MERGED.name)} as pack, cast(ordinal as bigint) as ordinal, name, pattern, cast(coalesce(n, 0) as bigint) as hits
from (values {_merged}) as rules(pack, ordinal, name, pattern) left join hits on rule = name"""


def audit_sql() -> str:
    parts = []
    for i, rule in enumerate(q.AUDITED, 1):
        if rule.name == "broken":
            parts.append(f"select {i} as ordinal, 'broken' as rule, false as valid, false as recursion_risk, 0 as hits, 0 as files")
            continue
        n = f"len(regexp_extract_all(content, {re2(rule, {})}))"
        risk = "true" if rule.name == "recursive" else "false"
        parts.append(f"select {i} as ordinal, {lit(rule.name)} as rule, true as valid, {risk} as recursion_risk, "
                     f"coalesce(sum({n}), 0) as hits, count(*) filter ({n} > 0) as files from src")
    return f"""with src as materialized ({CONFIGS}), every as ({' union all '.join(parts)})
select cast(ordinal as bigint) as ordinal, rule, valid, recursion_risk, cast(hits as bigint) as hits, cast(files as bigint) as files from every"""


def ambiguity_sql() -> str:
    kinds = {"doubled": "exponential", "either": "exponential", "twice": "quadratic", "spaces": "quadratic"}
    parts = []
    for i, rule in enumerate([*q.RISKY, *packs.VENDOR_PACKS["cisco"].rules], 1):
        n, kind = f"len(regexp_extract_all(content, {re2(rule, {})}))", kinds.get(rule.name, "none")
        parts.append(f"select {i} as ordinal, {lit(rule.name)} as rule, true as valid, {lit(kind)} as ambiguity, {str(kind != 'none').lower()} as shown, "
                     f"coalesce(sum({n}), 0) as hits, count(*) filter ({n} > 0) as files from src")
    return f"""with src as materialized ({CONFIGS}), every as ({' union all '.join(parts)})
select cast(ordinal as bigint) as ordinal, rule, valid, ambiguity, shown, cast(hits as bigint) as hits, cast(files as bigint) as files from every"""


def coverage_sql(source: str, listed_packs) -> str:
    parts = []
    for pack in listed_packs:
        ns = [f"len(regexp_extract_all(content, {re2(r, {})}))" for r in pack.rules]
        hit = " + ".join(f"(case when sum({n}) > 0 then 1 else 0 end)" for n in ns)
        parts.append(f"select {lit(pack.name)} as pack, cast({len(ns)} as bigint) as rules, cast({hit} as bigint) as rules_hit, "
                     f"cast(sum({' + '.join(ns)}) as bigint) as hits, count(*) filter ({' + '.join(ns)} > 0) as files from src")
    return f"with src as materialized ({source}) {' union all '.join(parts)}"


SQL["rule_audit"] = audit_sql()
SQL["rule_ambiguity"] = ambiguity_sql()
SQL["pack_coverage"] = coverage_sql(CONFIGS, packs.VENDOR_PACKS.values())
SQL["pack_coverage_library"] = coverage_sql(fx.RAW_SQL["documents"], [packs.LIBRARY])

# Accounts
_personal = " union all ".join(f"select {lit(u)} as username, 'personal' as kind, {i} as ordinal" for i, u in enumerate(fx.PERSONAL, 1))
_service = " union all ".join(f"select {lit(u)} as username, 'service' as kind, {i} as ordinal" for i, u in enumerate(fx.SERVICE, 1))
_customers = "select c_name as username, 'personal' as kind, c_custkey + 1 as ordinal from customer"
SQL["accounts_merged"] = f"""select username, kind, cast(min(ordinal) as bigint) as ordinal
from ({_customers} union all {_personal} union all {_service}) group by username, kind"""
SQL["account_occurrences"] = f"""with src as materialized ({CONFIGS}), a as ({_customers} union all {_personal}),
pairs as (select username, (length(content) - length(replace(content, username, ''))) / length(username) as n
  from src join a on contains(content, username))
select username, cast(sum(n) as bigint) as occurrences, count(*) as files from pairs group by username"""
SQL["rename_customers"] = f"""select f.path, replace(content, c_name, 'netadmin1') as sanitized,
  'Username ' || c_name || ' -> netadmin1 (1 occurrences)' as changes
from ({CONFIGS}) f join customer on f.filename like 'R-' || cast(c_custkey as string) || '.%'"""


def _rename_sql() -> str:
    steps = ["t0 as (select path, content as t, 0 as used from src)"]
    for i, u in enumerate(fx.PERSONAL):
        has = f"contains(t, {lit(u)})"
        n = f"cast((length(t) - length(replace(t, {lit(u)}, ''))) / {len(u)} as bigint)"
        message = f"case when {has} then {lit('Username ' + u + ' -> netadmin')} || cast(used + 1 as varchar) || ' (' || cast({n} as varchar) || ' occurrences)' end as m{i}"
        steps.append(f"t{i + 1} as (select * replace (case when {has} then replace(t, {lit(u)}, 'netadmin' || cast(used + 1 as varchar)) else t end as t, "
                     f"case when {has} then used + 1 else used end as used), {message} from t{i})")
    ms = ", ".join(f"m{i}" for i in range(len(fx.PERSONAL)))
    return f"with src as ({CONFIGS}), {', '.join(steps)} select path, t as sanitized, concat_ws('; ', {ms}) as changes from t{len(fx.PERSONAL)}"


SQL["rename_accounts"] = _rename_sql()
_lines = f"""src as ({CONFIGS}), cut as (select path, string_split(content, chr(10)) as l from src),
lines as (select path, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from cut),
users as (select path, cast(line_no as bigint) as line_no, regexp_extract(line, {re2(USER, {})}, 2) as username, line
  from lines where regexp_matches(line, {re2(USER, {})}))"""
SQL["username_lines"] = f"with {_lines} select path, line_no, username, line from users"
SQL["service_lines"] = f"with {_lines} select path, line_no, username from users where username in ({', '.join(map(lit, fx.SERVICE))})"
SQL["pseudonyms"] = f"""with {_lines}, firsts as (select path, username, min(line_no) as first_line from users
  where username in ({', '.join(map(lit, fx.PERSONAL))}) group by path, username)
select path, username, first_line, 'netadmin' || cast(dense_rank() over (partition by path order by first_line, username) as varchar) as alias from firsts"""
SQL["server_block_keys"] = f"""with {_lines},
heads as (select *, regexp_matches(line, '^(tacacs|radius) server .') as opens, not regexp_matches(line, '^[ \\t]') as bound from lines),
owned as (select *, max(case when bound then line_no end) over (partition by path order by line_no) as owner from heads),
keyed as (select o.path, split_part(h.line, ' ', 1) as service, split_part(h.line, ' ', 3) as block, o.line_no, o.line,
  row_number() over (partition by o.path, o.owner order by o.line_no) as r
  from owned o join heads h on h.path = o.path and h.line_no = o.owner and h.opens
  where regexp_matches(o.line, '^[ \\t]+key \\d+ \\S'))
select path, service, block, cast(line_no as bigint) as line_no, regexp_extract(line, '^[ \\t]+key (\\d+) (\\S+)', 1) as key_type,
  regexp_extract(line, '^[ \\t]+key (\\d+) (\\S+)', 2) as secret from keyed where r = 1"""

# Results and reports
SQL["secrets_by_type"] = f"""with {run_sql()} select label, cast(sum(n) as bigint) as total_count, count(distinct filename) as affected_files from found group by label"""
# Files of their own: names in several cases, some without a text, some that no scan selects.
_cased = f"""select 'R-' || cast(c_custkey as string) || [{', '.join(map(lit, q.FILE_CASES))}][c_custkey % {len(q.FILE_CASES)} + 1] as filename,
'/deep/' || filename as path, case when c_custkey % 10 = 9 then '' else {fx.CONFIG_TEXT} end as content from customer where [{', '.join(map(lit, q.FILE_CASES))}][c_custkey % {len(q.FILE_CASES)} + 1] not in ('.log', '.cFG')"""
SQL["scan_folder"] = f"select filename, content, cast(null as varchar) as error from ({_cased})"
SQL["sanitize_folder_dry"] = f"""select path[7:] as file, modified, changes, change_count, cast(null as varchar) as error from ({rewritten(_cased, BUILTIN)})
union all select '/no/such.cfg', false, '', 0, 'File not found: /no/such.cfg'"""
SQL["write_files"] = f"select path[10:] as name, cast(length(sanitized) as bigint) as length from ({rewritten(CONFIGS, BUILTIN)})"
SQL["dropped_file_errors"] = f"""with done as ({rewritten(f"select * from ({_cased}) where content <> ''", BUILTIN)})
select filename, case when length(content) <= {q.LONG_FILE} then sanitized end as sanitized, case when length(content) > {q.LONG_FILE} then {lit(TOO_LONG)} end as error,
  case when length(content) <= {q.LONG_FILE} then 'rows' else 'dead' end as table from done join ({_cased}) using (path)"""
SQL["findings_stream_batches"] = f"""with {run_sql()}, named as (select label, n, 'R-' || cast(c_custkey % 40 as string) || '.conf' as name
  from found join (select {fx.CONFIG_COLUMNS['path']} as path, c_custkey from customer) using (path))
select label, cast(sum(n) as bigint) as total_count, count(distinct name) as affected_files from named group by label"""
SQL["secrets_by_type_merged"] = f"select label, total_count, total_count as merged_count, affected_files, true as near from ({SQL['secrets_by_type']})"
SQL["sanitize_dropped_files"] = f"select split_part(path, '/', -1) as filename, sanitized, modified, change_count from ({rewritten(CONFIGS, BUILTIN)})"
SQL["findings_stream"] = SQL["secrets_by_type"]
_absent = "select '/configs/absent/R-' || cast(c_custkey as string) || '.conf' as path from customer"
_suffix = "regexp_extract(path, '^.+(\\.[^.]+)$', 1)"
_name = "split_part(path, '/', -1)"
_stem = f"left({_name}, length({_name}) - length({_suffix}))"
_backup = f"'/backups/' || {_stem} || '_20240131_120000_' || substr(md5(content), 1, 8) || '.' || {_suffix} || '.gz'"
_results = f"""{run_sql()}, results as (
select path as file, modified, m, cast(len(m) as bigint) as change_count, cast(null as varchar) as error, {_backup} as backup from run
union all select path, false, [], 0, 'File not found: ' || path, null from ({_absent}))"""
SQL["results"] = f"with {_results} select file, modified, coalesce(array_to_string(m, '; '), '') as changes, change_count, error, backup from results"
SQL["results_csv"] = f"""with {_results} select split_part(file, '/', -1) as "File", case when modified then 'Yes' else 'No' end as "Modified",
change_count as "Changes", coalesce(error, '') as "Error", coalesce(backup, '') as "Backup", '' as "Duration" from results"""
SQL["results_json"] = f"""with {_results} select file, '{{"file":"' || file || '","modified":' || case when modified then 'true' else 'false' end ||
',"changes":[' || coalesce(array_to_string(list_transform(m, lambda x: '"' || x || '"'), ','), '') || '],"change_count":' || cast(change_count as varchar) ||
',"error":' || coalesce('"' || error || '"', 'null') || ',"backup":' || coalesce('"' || backup || '"', 'null') || ',"duration":null}}' as json from results"""
SQL["results_written"] = f"""with {_results}, counted as (select split_part(file, '/', -1) as name, change_count, count(*) as lines from results group by all)
select file, modified, change_count, error, lines from (select *, split_part(file, '/', -1) as name from results) join counted using (name, change_count)"""
SQL["run_stats"] = f"""with {_results} select count(*) as files_processed, count(*) filter (modified) as files_modified,
cast(sum(change_count) as bigint) as total_changes, count(*) filter (error is not null) as errors from results"""
SQL["top_changed"] = f"with {run_sql()} select path as file, cast(len(m) as bigint) as change_count from run where modified order by len(m) desc, path limit 5"
_details = """per as (select archive, path, filename, label, sum(n) as n, min(ordinal) as o from found group by all),
details as (select r.archive, r.path, r.filename, cast(len(r.m) as bigint) as changes,
  string_agg(label || '=' || cast(n as varchar), ';' order by o) as secrets,
  string_agg('     - ' || label || ': ' || cast(n as varchar), chr(10) order by n desc, o) as txt,
  string_agg('- `' || label || '`: ' || cast(n as varchar), chr(10) order by n desc, o) as md,
  string_agg('        "' || label || '": ' || cast(n as varchar), ',' || chr(10) order by o) as js
  from run r join per using (archive, path) where r.modified and len(r.m) > 0 group by r.archive, r.path, r.filename, r.m)"""
SQL["file_details"] = f"with {run_sql()}, {_details} select path, filename, changes, secrets from details"
SQL["security_summary"] = f"""with {run_sql()} select cast(sum(n) as bigint) as total_secrets_found, count(distinct path) as files_containing_secrets,
count(distinct label) as secret_types_detected from found"""
_report = f"""types as (select archive, label, cast(sum(n) as bigint) as total_count, count(distinct filename) as affected_files from found group by archive, label),
packed as (select archive, sum(total_count) as total, count(*) as kinds,
  string_agg(label || '=' || cast(total_count as varchar) || '=' || cast(affected_files as varchar), ';' order by total_count desc, label) as listed from types group by archive),
report as (select r.archive, count(*) as files, count(*) filter (modified and len(m) > 0) as hit, cast(coalesce(any_value(total), 0) as bigint) as total,
  coalesce(any_value(kinds), 0) as kinds, coalesce(any_value(listed), '') as listed from run r left join packed p on p.archive = r.archive group by r.archive)"""
SQL["security_report"] = f"""with {run_sql()}, {_report}
select archive, {lit(q.GENERATED_AT)} as generated_at, files as total_files_extracted, hit as total_files_sanitized, total as total_secrets_found,
hit as files_containing_secrets, kinds as secret_types_detected, listed as secrets_by_type from report"""


def _fill(text: str) -> str:
    """A text with {sql} parts as a SQL concatenation."""
    pieces = text.replace("}", "{").split("{")
    return " || ".join(lit(p) if i % 2 == 0 else f"cast({p} as varchar)" for i, p in enumerate(pieces) if i % 2 or p)


def _document(head: str, kind: str, files: str, each: str, tail: str, always_files: bool) -> str:
    return f"""with {run_sql()}, {_details}, {_report},
ranked as (select *, row_number() over (partition by archive order by changes desc, path) as idx, count(*) over (partition by archive) as total from details),
kinds_ranked as (select *, row_number() over (partition by archive order by total_count desc, label) as idx, count(*) over (partition by archive) as total from types)
select archive, cast(0 as bigint) as section, cast(0 as bigint) as idx, {head} as line from report
union all select archive, 1, idx, {kind} from kinds_ranked
union all select archive, 2, 0, {files} from report where {'true' if always_files else 'hit > 0'}
union all select archive, 3, idx, {each} from ranked
union all select archive, 4, 0, {tail} from report"""


_types_txt = lit(f"\n{DASH_80}\nSECRETS BY TYPE\n{DASH_80}")
SQL["report_txt"] = _document(
    _fill(f"{RULE_80}\nNETWORK CONFIGURATION SANITIZATION SECURITY REPORT\n{RULE_80}\n\nGenerated: {q.GENERATED_AT}\nTool: {GENERATOR}\n\n"
          f"{DASH_80}\nARCHIVE INFORMATION\n{DASH_80}\nOriginal Archive: {{archive}}\nSanitized Output: {{archive}}\nTotal Files: {{files}}\n"
          f"Files Sanitized: {{hit}}\n\n{DASH_80}\nSECURITY SUMMARY\n{DASH_80}\nTotal Secrets Found: {{total}}\nFiles With Secrets: {{hit}}\n"
          f"Secret Types: {{kinds}}\n") + f" || case when kinds > 0 then {_types_txt} else '' end",
    _fill("\n{label}:\n  Count: {total_count}\n  Affected Files: {affected_files}"),
    lit(f"\n{DASH_80}\nMODIFIED FILES\n{DASH_80}"),
    _fill("\n{idx}. {filename}\n   Total Changes: {changes}\n   Secrets Found:\n{txt}"),
    lit(f"\n{RULE_80}\nEND OF REPORT\n{RULE_80}"), False)
_types_md = lit("\n## Secrets by Type\n\n| Secret Type | Total Count | Affected Files |\n|-------------|-------------|----------------|")
SQL["report_md"] = _document(
    _fill(f"# Network Configuration Sanitization Security Report\n\n## Report Metadata\n\n- **Generated:** {q.GENERATED_AT}\n- **Tool:** {GENERATOR}\n"
          f"- **Version:** {REPORT_VERSION}\n\n## Archive Information\n\n- **Original Archive:** `{{archive}}`\n- **Sanitized Output:** `{{archive}}`\n"
          "- **Total Files Extracted:** {files}\n- **Files Sanitized:** {hit}\n\n## Security Summary\n\n- **Total Secrets Found:** {total}\n"
          "- **Files Containing Secrets:** {hit}\n- **Secret Types Detected:** {kinds}\n") + f" || case when kinds > 0 then {_types_md} else '' end",
    _fill("| {label} | {total_count} | {affected_files} |"),
    lit("\n## Modified Files\n"),
    _fill("### {idx}. {filename}\n\n**Total Changes:** {changes}\n\n**Secrets Found:**\n\n{md}\n"),
    lit(f"---\n\n*Report generated by {GENERATOR}*"), False)


def _js(text: str) -> str:
    """Like _fill, with ( ) marks for braces: << and >> stand for { and }."""
    return _fill(text).replace("<<", "{").replace(">>", "}")


SQL["report_json"] = _document(
    _js(f'<<\n  "report_metadata": <<\n    "generated_at": "{q.GENERATED_AT}",\n    "generated_by": "{GENERATOR}",\n    "report_version": "{REPORT_VERSION}"\n  >>,\n'
        '  "archive_info": <<\n    "original_archive": "{archive}",\n    "sanitized_output": "{archive}",\n    "total_files_extracted": {files},\n'
        '    "total_files_sanitized": {hit}\n  >>,\n  "security_summary": <<\n    "total_secrets_found": {total},\n    "files_containing_secrets": {hit},\n'
        '    "secret_types_detected": {kinds}\n  >>,\n  "secrets_by_type": <<'),
    _js('    "{label}": <<\n      "total_count": {total_count},\n      "affected_files": {affected_files}\n    >>') + " || case when idx < total then ',' else '' end",
    _js('  >>,\n  "file_details": ['),
    _js('    <<\n      "filename": "{filename}",\n      "changes": {changes},\n      "secrets_by_type": <<\n{js}\n      >>\n    >>') + " || case when idx < total then ',' else '' end",
    _js("  ]\n>>"), True)

# Files, paths, archives
SQL["missing_inputs"] = f"select path, 'File not found: ' || path as error from ({_absent})"
SQL["file_list"] = f"select distinct path from (select path from ({CONFIGS}) union all {_absent}) order by path"


def _is_config(name: str) -> str:
    tests = [f"ends_with({name}, {lit(s)})" for s in CONFIG_SUFFIXES] + [f"contains(lower({name}), {lit(w)})" for w in CONFIG_WORDS]
    return "(" + " or ".join(tests) + ")"


SQL["classify_files"] = f"select member, {_is_config('member')} as is_config, {_is_config('filename')} as name_is_config from ({CONFIGS})"
SQL["path_parts"] = f"""select path, {_name} as name, {_stem} as stem, {_suffix} as suffix,
left(path, length(path) - length({_name}) - 1) as parent, substr(path, 10) as relative from ({CONFIGS})"""
_parent = f"left(path, length(path) - length({_name}))"
SQL["sanitized_names"] = f"""select path, {_parent} || {_stem} || '_sanitized' || {_suffix} as in_place, {_parent} || {_stem} || '_sanitized' || {_suffix} as again,
{_parent} || {_stem} || '_sanitized.tar.gz' as as_tar, {_parent} || {_stem} || '_sanitized_20240131_120000' as folder from ({CONFIGS})"""
_sfx = [*ARCHIVE_SUFFIXES, ".conf"]
_kinds = " ".join(f"when ends_with(lower(name), {lit(s)}) then {lit(k)}" for s, k in ARCHIVE_SUFFIXES.items())
SQL["archive_types"] = f"""with named as (select c_custkey, 'A-' || cast(c_custkey as string) || ([{', '.join(map(lit, _sfx))}])[c_custkey % 14 + 1] as n from customer),
cased as (select case when c_custkey % 2 = 0 then upper(n) else n end as name from named) select name, case {_kinds} end as kind from cased"""
for _fmt in ("zip", "tar", "tar.gz", "tar.bz2", "tar.xz"):
    SQL["roundtrip_" + _fmt.replace(".", "_")] = f"""select regexp_replace(archive, '\\.zip$', '') || '.{_fmt}' as archive, member,
cast(length(content) as bigint) as size, md5(content) as digest, cast(null as varchar) as error from ({CONFIGS})"""
SQL["roundtrip_volumes"] = f"select archive, member, cast(length(content) as bigint) as size, md5(content) as digest from ({CONFIGS})"
_by_content = {"zip": "zip", "tar": "tar", "tar.gz": "gzip", "tar.bz2": "bzip2", "tar.xz": "xz"}
SQL["archive_types_by_content"] = " union all ".join(
    f"select distinct 'bare/site-' || cast(c_nationkey as string) as path, '{f}' as packed_as, '{k}' as kind from customer" for f, k in _by_content.items())
SQL["refused_archives"] = f"""select filename || case when ends_with(filename, '.CFG') then '.7z' when ends_with(filename, '.txt') then '.zip' else '' end as archive,
case when ends_with(filename, '.CFG') then 'Extraction not supported for 7zip' when ends_with(filename, '.txt') then 'Failed to extract archive'
else 'Unsupported archive format' end as error from ({CONFIGS})"""
SQL["archive_errors"] = f"""select path || '.rar' as archive, filename || '.rar: Extraction not supported for rar' as error
from ({CONFIGS})"""
SQL["expand_compressed_files"] = f"""with cut as (select unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) as line from ({CONFIGS})),
counted as (select line, count(*) as n from cut group by line)
select codec, line, n from counted cross join (select unnest(['gzip', 'bzip2']) as codec)"""
SQL["decode_documents"] = f"""with raw as (select id, replace(content, chr(10), chr(13) || chr(10)) as t from ({fx.RAW_SQL['documents']}))
select id, replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(65533), '') as content,
  cast(length(replace(t, chr(65533), '')) as bigint) as kept from raw"""
SQL["roundtrip_flat"] = f"select archive, filename as member, cast(length(content) as bigint) as size, md5(content) as digest from ({CONFIGS})"
_listed = "select archive, row_number() over (partition by archive order by member) as position, count(*) over (partition by archive) as members, member"
SQL["archive_members"] = f"{_listed}, {_is_config('member')} as is_config from ({CONFIGS})"
_data = f"select archive, regexp_replace(member, '^cfg/', 'data/') as member from ({CONFIGS})"
SQL["archive_config_files"] = f"{_listed} from ({_data}) where {_is_config('member')}"
SQL["archive_info"] = f"""select archive, count(*) as total_files, count(*) filter ({_is_config('member')}) as config_files,
round(sum(length(content)) / 1048576.0, 2) as size_mb, false as encrypted from ({CONFIGS}) group by archive"""
SQL["sanitize_archives"] = f"""with done as ({rewritten(CONFIGS, BUILTIN, "filename", keep=", archive").replace("select filename, c as", "select filename, archive, content, c as").replace("select filename, sanitized", "select filename, archive, content, sanitized")})
select archive || '.tar.gz' as archive, 'data/' || filename as member, case when {_is_config("filename")} then sanitized else content end as content from done"""
SQL["archive_result"] = f"""with {run_sql()} select archive, count(*) as extracted_files, count(*) filter (modified) as sanitized_files, cast(0 as bigint) as errors from run group by archive"""
SQL["name_clashes"] = f"select archive, filename as name, cast(2 as bigint) as members from ({CONFIGS})"
SQL["member_preview"] = f"""select archive, member, position from (select archive, member, row_number() over (partition by archive order by member) as position
from ({CONFIGS})) where position <= 10"""
SQL["scan_written_files"] = f"select filename, content from ({CONFIGS})"
SQL["write_sanitized"] = f"select path, sanitized as content, modified from ({rewritten(CONFIGS, BUILTIN)})"

# Backups
_stamp = "strftime(ts, '%Y%m%d_%H%M%S')"
_backups = fx.backups_sql(_stamp)
_one_day = " union all ".join(
    f"""select '/backups/' || {_stem} || '_{d.replace('-', '')}_120000_' || substr(md5(content), 1, 8) || '.' || {_suffix} || '.gz' as backup_path,
path as original_path, '{d.replace('-', '')}_120000' as timestamp, substr(md5(content), 1, 8) as file_hash, true as compressed,
cast(length(content) as bigint) as size, '{d}' as backup_date from ({CONFIGS})""" for d in ("2024-01-30", "2024-01-31"))
SQL["append_backup"] = _one_day
_latest = "select * exclude (r) from (select *, row_number() over (partition by original_path order by timestamp desc, backup_path desc) as r from ({0})) where r = 1"
SQL["latest_backup"] = _latest.format(_backups)
SQL["asof_backup"] = _latest.format(f"select * from ({_backups}) where starts_with(timestamp, '20240115')")
SQL["restore_files"] = f"""with latest as ({_latest.format(_backups)}),
wanted as (select '/configs/click/R-' || cast(c_custkey as string) || '.conf' as path from customer)
select path, backup_path, timestamp, backup_path is not null as restored from wanted left join latest on original_path = path"""
_day = "select '{0}' as day, path, case when content is not null then '{1}_120000' end as timestamp, content is not null as restored, md5({2}) as digest from ({3}) left join ({4}) c using (path)"
_asked = f"select path from ({CONFIGS}) union all {_absent}"
SQL["restore_contents"] = f"""{_day.format('20240130', '20240130', 'content', _asked, CONFIGS)}
union all {_day.format('2024', '20240131', "content || '! changed' || chr(10)", _asked, CONFIGS)}"""
SQL["restore_directory"] = f"""with latest as ({_latest.format(_backups)}), folders as (select distinct '/configs/' || event_type as directory from events union select '/' from events)
select directory, original_path, backup_path, timestamp from latest join folders on starts_with(original_path, rtrim(directory, '/') || '/')"""
SQL["list_backups"] = f"select * from ({_backups}) order by timestamp desc, backup_path"
SQL["list_backups_of_file"] = f"select * from ({_backups}) where original_path = '/configs/click/R-7.conf' order by timestamp desc, backup_path"
_taken = "strptime(timestamp, '%Y%m%d_%H%M%S')"
_cut = f"timestamp '{q.NOW:%Y-%m-%d %H:%M:%S}' - interval {q.RETENTION_DAYS} day"
SQL["retained_backups"] = f"select backup_path, timestamp from ({_backups}) where {_taken} >= {_cut}"
SQL["cleanup_backups"] = SQL["retained_backups"]
SQL["expired_backups"] = f"select backup_path, timestamp from ({_backups}) where {_taken} < {_cut}"
SQL["backup_stats"] = f"""select count(*) as total_backups, cast(sum(size) as bigint) as total_size, round(sum(size) / 1048576.0, 2) as total_size_mb,
min(timestamp) as oldest_backup, max(timestamp) as newest_backup from ({_backups})"""

# Hashes, logs
_snmp = packs.LIBRARY.subset(["snmp_community"]).rules[0]
SQL["token_hash"] = f"""select value, upper(substr(md5('snmp_' || cast(row_number() over (order by value) as varchar)), 1, 12)) as token
from (select distinct value from ({detected(CONFIGS, "path", [_snmp], shown=None)}))"""
SQL["content_hash"] = f"select id, md5(content) as digest, substr(md5(content), 1, 8) as short from ({fx.RAW_SQL['documents']})"
_words = "|".join(SENSITIVE_WORDS)
SQL["redact_logs"] = f"""with logs as (select event_id, {fx.LOG_MESSAGE} as message from events)
select event_id, case when regexp_matches(lower(message), '{_words}') and contains(message, '=')
then regexp_replace(message, '(^| )([^ =]*)=[^ ]*', '\\1\\2=<redacted>', 'g') else message end as message from logs"""
SQL["redact_log_stream"] = SQL["redact_logs"]
