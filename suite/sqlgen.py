"""DuckDB SQL for the checks: spans of patterns, overlap resolution, checksums, entropy."""

from __future__ import annotations

from veilframe.rules.client import IPV4, PHONE_CORE
from veilframe.rules.model import Rule


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(rule: Rule) -> str:
    """The rule's pattern for an engine with ASCII word boundaries but no lookaround."""
    core = (rule.core.replace("(?!ant-)", "").replace(r"(?!000|666|9\d{2})", "")
            .replace("(?!00)", "").replace("(?!0000)", ""))
    flag, core = ("(?i)", core[4:]) if core.startswith("(?i)") else ("", core)
    return flag + (r"\b" if rule.left else "") + core + (r"\b" if rule.right else "")


def digits_of(v: str) -> str:
    return rf"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn_sql(v: str, strip: str = r"[\s-]") -> str:
    """Luhn over 13 to 19 digits."""
    d = f"regexp_replace({v}, '{strip}', '', 'g')"
    digit = f"CAST(substr(reverse({d}), q, 1) AS INT)"
    weighed = (f"CASE WHEN q % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 "
               f"ELSE {digit} * 2 END")
    return (f"(CASE WHEN regexp_full_match({d}, '[0-9]{{13,19}}') THEN "
            f"list_sum(list_transform(range(1, length({d}) + 1), lambda q: {weighed})) % 10 = 0 "
            f"ELSE false END)")


# The group operation as the check sees it: composed from rotations and reflections of a
# pentagon instead of the library's table.
def _product(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} < 5 THEN CASE WHEN {b} < 5 THEN ({a} + {b}) % 5 "
            f"ELSE 5 + ({a} + {b} - 5) % 5 END ELSE CASE WHEN {b} < 5 THEN "
            f"5 + ({a} - 5 - {b} + 5) % 5 ELSE ({a} - {b} + 5) % 5 END END)")


def verhoeff_fold_sql(d: str, shift: int) -> str:
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows, row = [], list(range(10))
    for _ in range(8):
        rows.append(row)
        row = [step[x] for x in row]
    flat = "[" + ", ".join(str(x) for r in rows for x in r) + "]"
    permuted = (f"list_transform(range(0, length({d})), lambda q: "
                f"{flat}[((q + {shift}) % 8) * 10 + "
                f"CAST(substr(reverse({d}), q + 1, 1) AS INT) + 1])")
    return (f"list_reduce(list_concat([0], {permuted}), lambda a, b: {_product('a', 'b')})")


def verhoeff_sql(v: str) -> str:
    d = rf"regexp_replace({v}, '[\s-]', '', 'g')"
    return (f"(CASE WHEN regexp_full_match({d}, '[2-9][0-9]{{11}}') THEN "
            f"{verhoeff_fold_sql(d, 0)} = 0 ELSE false END)")


def entropy_sql(v: str) -> str:
    chars = f"string_split({v}, '')"
    share = f"(len(list_filter({chars}, lambda z: z = c)) / CAST(len({chars}) AS DOUBLE))"
    return (f"(CASE WHEN length({v}) = 0 THEN 0.0 ELSE list_sum(list_transform("
            f"list_distinct({chars}), lambda c: -{share} * log2({share}))) END)")


def spans_of(regex: str, source: str = "corpus", columns: str = "doc_id", keep: str = "true",
             group: bool = False) -> str:
    """SELECT columns, i, s, e, v of every match of a pattern in ``source``.

    ``group``: the span is group 1, which stands at the end of the match.
    """
    r = quote(regex)
    part = f", regexp_extract_all(text, {r}, 1) AS pt" if group else ""
    inner = (f"SELECT {columns}, text, regexp_extract_all(text, {r}, 0) AS h, "
             f"regexp_split_to_array(text, {r}) AS g{part} "
             f"FROM {source} WHERE regexp_matches(text, {r})")
    start = ("CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum("
             "list_transform(h[1:i-1], lambda x: length(x))), 0) AS INT)")
    if group:
        start = f"({start} + length(h[i]) - length(pt[i]))"
        value = "trim(pt[i], ' ' || chr(9) || chr(10) || chr(13))"
    else:
        value = "h[i]"
    return (f"SELECT * FROM (SELECT {columns}, text, i, {start} AS s, "
            f"{start} + length({value}) AS e, {value} AS v "
            f"FROM ({inner}) m, UNNEST(range(1, len(h) + 1)) u(i)) w WHERE {keep}")


def client_phone_spans(source: str = "corpus") -> str:
    """Phone numbers whose neighbours must not be token characters, start by start."""
    anchored = "^(" + PHONE_CORE + r")(?:$|[^A-Za-z0-9_.\-])"
    starts = ("list_filter(range(1, len(ch) + 1), lambda p: regexp_matches(ch[p], '[+(0-9]') "
              r"AND (p = 1 OR NOT regexp_matches(ch[p-1], '[A-Za-z0-9_.\-]')))")
    cands = (f"SELECT doc_id, text, p, regexp_extract(array_to_string(ch[p:p+24], ''), "
             f"{quote(anchored)}, 1) AS v FROM (SELECT doc_id, text, ch, "
             f"UNNEST({starts}) AS p FROM (SELECT doc_id, text, string_split(text, '') AS ch "
             f"FROM {source} WHERE regexp_matches(text, '[0-9]{{3}}[-.\\s]?[0-9]{{4}}')) a) b")
    found = (f"SELECT doc_id, text, CAST(p - 1 AS INT) AS s, CAST(p - 1 + length(v) AS INT) AS e,"
             f" v FROM ({cands}) c WHERE v <> ''")
    return (f"SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i, s, e,"
            f" v FROM ({found}) f WHERE NOT EXISTS (SELECT 1 FROM ({found}) o WHERE "
            f"o.doc_id = f.doc_id AND o.s < f.s AND o.e > f.s)")


def rule_spans(rules, source: str = "corpus", min_length: int = 1) -> str:
    """SELECT doc_id, ord, i, s, e, v, type, label of all rules, checked and anchored."""
    parts = []
    for ord_, r in enumerate(rules):
        keep = "true"
        if r.check == "luhn":
            keep = luhn_sql("v")
        elif r.check == "luhn_digits":
            keep = luhn_sql("v", "[^0-9]")
        elif r.check == "verhoeff":
            keep = verhoeff_sql("v")
        if r.near:
            window = ("lower(substr(text, greatest(0, s - 50) + 1, "
                      "e + 50 - greatest(0, s - 50)))")
            keep += " AND (" + " OR ".join(f"contains({window}, {quote(k)})" for k in r.near) + ")"
        if "(?!ant-)" in r.core:
            keep += " AND NOT starts_with(v, 'sk-ant-')"
        if "(?!000" in r.core:
            keep += (" AND NOT regexp_matches(v, '^(000|666|9)') AND substr(v, 5, 2) <> '00' "
                     "AND substr(v, 8) <> '0000'")
        if min_length > 1:
            keep += f" AND length(v) >= {min_length}"
        if r.id == "PHONE" and not r.left:
            body = client_phone_spans(source)
        elif r.id == "IP_ADDRESS" and not r.left:
            body = spans_of(r"[A-Za-z0-9_.\-]+", f"(SELECT * FROM {source} WHERE "
                            r"regexp_matches(text, '[0-9]\.[0-9]+\.[0-9]'))",
                            keep=f"regexp_full_match(v, {quote(IPV4)})")
        else:
            body = spans_of(re2(r), source, keep=keep, group=bool(r.group))
        parts.append(f"SELECT doc_id, {ord_} AS ord, i, s, e, v, {quote(r.span_type)} AS type, "
                     f"{quote(r.label)} AS label FROM ({body}) r{ord_}")
    return " UNION ALL ".join(parts)


TOKEN_RE2 = r"\b[A-Za-z0-9_.\-]{16,128}\b"
MIXED = "regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')"


def entropy_spans(found: str | None, source: str = "corpus") -> str:
    """High-entropy tokens: the client's (not inside ``found``) or the gateway's."""
    level = (f"round({entropy_sql('v')}, 3) >= 3.7" if found else f"{entropy_sql('v')} > 3.8")
    body = spans_of(TOKEN_RE2, source, keep=f"{MIXED} AND {level}")
    free = (f" WHERE NOT EXISTS (SELECT 1 FROM {found} f WHERE f.doc_id = t.doc_id "
            f"AND t.s >= f.s AND t.s < f.e)" if found else "")
    return (f"SELECT doc_id, 900 AS ord, i, s, e, v, 'HIGH_ENTROPY_SECRET' AS type, "
            f"'[HIGH_ENTROPY_REDACTED]' AS label FROM ({body}) t{free}")


def resolve(found: str, rule: str) -> str:
    """SELECT doc_id, k (one struct per kept span): longest first or leftmost."""
    order = {"longest": "e - s DESC, ord, i, s", "leftmost": "s, e - s DESC, ord, i",
             "start": "s, ord, i"}[rule]
    free = "len(list_filter(acc, lambda o: nx[1].s < o.e AND nx[1].e > o.s)) > 0"
    return (f"SELECT doc_id, UNNEST(list_reduce(list_transform(l, lambda x: [x]), "
            f"lambda acc, nx: CASE WHEN {free} THEN acc ELSE list_concat(acc, nx) END)) AS k "
            f"FROM (SELECT doc_id, list(struct_pack(s := s, e := e, v := v, type := type, "
            f"label := label) ORDER BY {order}) AS l FROM {found} GROUP BY doc_id) z")


def splice(source: str, kept: str, label: str = "k.label") -> str:
    """SELECT doc_id, text, out: each text of ``source`` with its kept spans replaced."""
    return (f"SELECT c.doc_id, c.text, CASE WHEN p.doc_id IS NULL THEN c.text ELSE p.body || "
            f"substr(c.text, p.last_e + 1) END AS out FROM {source} c LEFT JOIN ("
            f"SELECT doc_id, string_agg(substr(text, prev + 1, s - prev) || label, '' ORDER BY s)"
            f" AS body, max(e) AS last_e FROM (SELECT x.doc_id, t.text, x.s, x.e, x.label, "
            f"coalesce(lag(x.e) OVER (PARTITION BY x.doc_id ORDER BY x.s), 0) AS prev FROM ("
            f"SELECT doc_id, k.s AS s, k.e AS e, {label} AS label FROM {kept}) x JOIN {source} t "
            f"ON t.doc_id = x.doc_id) y GROUP BY doc_id) p ON p.doc_id = c.doc_id")


def types_sql(kept: str) -> str:
    return (f"SELECT doc_id, string_agg(DISTINCT k.type, ';' ORDER BY k.type) AS types, "
            f"count(DISTINCT k.v) AS n_values, count(*) AS n_spans FROM {kept} GROUP BY doc_id")
