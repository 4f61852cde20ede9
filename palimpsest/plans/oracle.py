"""DuckDB SQL for detection, overlap resolution and redaction, from the original expressions in RE2's dialect."""

from __future__ import annotations

from palimpsest.operators import advanced, overlap, rewrite, secrets
from palimpsest.sources.patterns import Pattern, load

from .fixtures import TEXTS, sql_values

#: Key groups of the assignment expressions before they are guarded against long runs of words.
AWS = rf"""(?i)(?:\bexport\s+)?["']?({secrets._AWS_LONG}|{secrets._AWS_SHORT}){secrets._SEPARATOR}{secrets._VALUE}"""
GENERIC = rf"""(?i)(?:\bexport\s+)?["']?([{secrets._CLASS}]*(?:{secrets._KEYWORDS})[{secrets._CLASS}]*){secrets._SEPARATOR}{secrets._VALUE}"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(documents: bool = True) -> str:
    """id, t of the documents and the fixed texts."""
    fixed = f"SELECT id, t FROM {sql_values(TEXTS)} AS v(id, t)"
    return f"SELECT doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL {fixed}" if documents else fixed


def matches(regex: str, groups: int = 0, text: str = "t", source: str = "src") -> str:
    """id, t, m, cs, ce (characters) and g1 ... of all non-empty matches."""
    r = quoted(regex)
    inner = "".join(f", regexp_extract_all({text}, {r}, {k + 1}) AS l{k + 1}" for k in range(groups))
    outer = "".join(f", unnest(l{k + 1}) AS g{k + 1}" for k in range(groups))
    names = "".join(f", g{k + 1}" for k in range(groups))
    return f"""SELECT id, t, m, cs, cs + length(m) AS ce{names} FROM (
  SELECT id, t, unnest(l) AS m, unnest(list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(l[1:i - 1], lambda y: length(y))), 0)))::INT AS cs{outer}
  FROM (SELECT id, t, regexp_extract_all({text}, {r}) AS l, string_split_regex({text}, {r}) AS g{inner} FROM {source}) WHERE len(l) > 0) WHERE m <> ''"""


def _spans(rows: str, type_: str, severity: str, pattern: str, matched: str = "m", where: str = "true") -> str:
    as_sql = lambda x: x if x.startswith("CASE") else quoted(x)
    return f"SELECT id, t, {as_sql(type_)} AS type, {as_sql(severity)} AS severity, {as_sql(pattern)} AS pattern, {matched} AS matched, cs, ce FROM ({rows}) WHERE {where}"


def of_pattern(p: Pattern) -> str:
    return _spans(matches(p.regex), p.type, p.severity, p.name)


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN ({DIGITS})[i]::INT ELSE (({DIGITS})[i]::INT * 2) // 10 + (({DIGITS})[i]::INT * 2) % 10 END)) % 10 = 0"
COMPACT = "upper(replace(m, ' ', ''))"
_TURNED = f"(substr({COMPACT}, 5) || substr({COMPACT}, 1, 4))"
MOD97 = f"list_reduce(list_transform(range(1, length({_TURNED}) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({_TURNED}, i, 1)) - 1), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END, 0) = 1"
_TRIM = lambda g: f"regexp_replace({g}, '[\\s,;]+$', '')"
BARE = lambda g: f"(CASE WHEN strlen({_TRIM(g)}) >= 2 AND {_TRIM(g)}[1] IN ('\"', '''') THEN CASE WHEN instr(substr({_TRIM(g)}, 2), {_TRIM(g)}[1]) > 0 THEN substr({_TRIM(g)}, 2, instr(substr({_TRIM(g)}, 2), {_TRIM(g)}[1]) - 1) ELSE substr({_TRIM(g)}, 2) END ELSE {_TRIM(g)} END)"
KEY = lambda g: f"lower(regexp_replace({g}, '[-_\\s]', '', 'g'))"


def cards() -> str:
    return _spans(matches(advanced.CARD), "financial", "BLOCK", "credit_card", DIGITS, f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}")


def ibans() -> str:
    return _spans(matches(advanced.IBAN), "financial", "BLOCK", "iban", COMPACT, f"regexp_full_match({COMPACT}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND length({COMPACT}) BETWEEN 15 AND 34 AND {MOD97}")


def phones() -> str:
    number = f"(CASE WHEN m[1] = '+' THEN '+' ELSE '' END || {DIGITS})"
    form = lambda rx: rx.replace(r"\A", "").replace(r"\z", "")
    country = "CASE " + " ".join(f"WHEN regexp_full_match({number}, {quoted(form(rx))}) THEN '{n}'" for n, rx in advanced.PHONE_FORMS) + " END"
    return _spans(f"SELECT * FROM (SELECT *, {country} AS country FROM ({matches(advanced.PHONE)})) WHERE country IS NOT NULL", "pii", "WARN", "CASE WHEN true THEN country END")


def split_emails() -> str:
    return _spans(matches(advanced.SPLIT_EMAIL, 2), "pii", "BLOCK", "email", "g1 || '@' || g2", "contains(m, ' ') OR contains(m, '+')")


def passwords() -> str:
    key = "regexp_replace(translate(lower(g1), '@0$51!37', 'aossiiet'), '[^a-z]', '', 'g')"
    value = """regexp_replace(g2, '^["'']+|["'']+$', '', 'g')"""
    return _spans(matches(advanced.PASSWORD, 2), "credential", "BLOCK", "password_var", "m", f"{key} IN ('password', 'passwd', 'pwd') AND strlen({value}) >= 8")


def base64_runs() -> str:
    shown = f"CASE WHEN length(m) % 4 = 0 THEN regexp_matches(from_base64(m)::VARCHAR, {quoted(advanced.SIGNATURE)}) ELSE false END"
    return _spans(matches(advanced.BASE64), "credential", "WARN", "base64_encoded_secret", "m", shown)


def canonical_emails() -> str:
    """Confusable letters only; texts with percent escapes are left to tests."""
    email = next(p for p in load() if p.name == "email")
    view = f"translate(t, '{advanced.CONFUSABLE}', '{advanced.LATIN}')"
    return _spans(matches(email.regex, text=view, source="(SELECT * FROM src WHERE strlen(t) > length(t))"), "pii", "BLOCK", "email")


def escaped_uris() -> str:
    """CTEs after src and the rows: matches in the texts without interruptions, brought back by the order of the kept characters."""
    dropped = r"\\[nrt]|[\n\r\t]"
    broken = rf":(?:{dropped})*/(?:{dropped})*/"
    view = f"regexp_replace(t, {quoted(dropped)}, '', 'g')"
    found = " UNION ALL ".join(_spans(matches(p.regex, text="v", source="cut"), p.type, p.severity, p.name) for p in load() if p.name in advanced.URI_PATTERNS)
    return f""", cut AS (SELECT id, t, {view} AS v FROM src WHERE regexp_matches(t, {quoted(broken)}) AND regexp_matches(t, {quoted(dropped)}) AND regexp_matches({view}, '(?:postgres|mongodb(?:\\+srv)?|mysql)://')),
units AS (SELECT id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT id, regexp_extract_all(t, {quoted(r"(?s)\\[nrt]|.")}) AS u FROM cut)),
placed AS (SELECT id, x, i, (sum(length(x)) OVER (PARTITION BY id ORDER BY i))::BIGINT AS e FROM units),
kept AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, e - length(x) AS b, e FROM placed WHERE NOT regexp_full_match(x, {quoted(dropped)})),
uris AS (SELECT f.id, t, type, severity, pattern, substr(t, a.b + 1, z.e - a.b) AS matched, a.b AS cs, z.e AS ce FROM ({found}) f JOIN kept a ON a.id = f.id AND a.k = f.cs + 1 JOIN kept z ON z.id = f.id AND z.k = f.ce)"""


def aws() -> str:
    ids = _spans(matches(secrets._KEY_ID), "credential", "BLOCK", "aws_access_key_id")
    secret = f"{KEY('g1')} IN ('awssecretaccesskey', 'secretaccesskey') AND regexp_full_match({BARE('g3')}, '[A-Za-z0-9/+=]{{40}}')"
    session = f"{KEY('g1')} IN ('awssessiontoken', 'sessiontoken') AND regexp_full_match({BARE('g3')}, '[A-Za-z0-9/+=]{{80,}}')"
    assigned = _spans(matches(AWS, 3), "credential", "BLOCK", f"CASE WHEN {secret} THEN 'aws_secret_access_key' ELSE 'aws_session_token' END", "m", f"({secret}) OR ({session})")
    return f"{ids} UNION ALL {assigned}"


def generic() -> str:
    """Key-value secrets that meet no AWS span (those of the relation aws)."""
    value = BARE("g3")
    classes = " + ".join(f"regexp_matches({value}, '{rx}')::INT" for rx in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{Ll}\p{Lu}\p{Nd}]"))
    count = lambda c: f"(length({value}) - length(replace({value}, {c}, '')))"
    entropy = f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda c: -({count('c')} / length({value})) * log2({count('c')} / length({value}))))"
    compact = KEY("g1")
    name = f"CASE WHEN contains({compact}, 'privatekey') THEN 'generic_private_key_assignment' WHEN contains({compact}, 'apikey') THEN 'generic_api_key_assignment' WHEN contains({compact}, 'token') THEN 'generic_token_assignment' ELSE 'generic_secret_assignment' END"
    rows = f"SELECT g.* FROM ({matches(GENERIC, 3)}) g WHERE NOT EXISTS (SELECT 1 FROM aws a WHERE a.id = g.id AND a.cs < g.ce AND g.cs < a.ce)"
    return _spans(rows, "credential", "BLOCK", name, "m", f"strlen({value}) >= {secrets.MIN_LENGTH} AND ({classes}) >= 2 AND {entropy} >= {secrets.MIN_ENTROPY}")


def _rank(column: str, ranks: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {-v}" for k, v in ranks.items()) + " ELSE 0 END"


def detection(documents: bool = True, everything: bool = True) -> str:
    """CTEs up to ``raw`` (all spans) and ``kept`` (those that stay), of the patterns alone or of all detectors."""
    parts = [of_pattern(p) for p in load()]
    aws_cte = ""
    if everything:
        aws_cte = f"aws AS ({aws()}),\n"
        parts += ["SELECT * FROM aws", generic(), cards(), ibans(), phones(), split_emails(), passwords(), base64_runs(), canonical_emails()]
    union = "\nUNION ALL ".join(parts)
    order = f"{_rank('severity', overlap.SEVERITY_RANK)}, {_rank('type', overlap.TYPE_RANK)}, {_rank('pattern', overlap.PATTERN_RANK)}, position - \"end\", position, pattern, matched"
    return f"""WITH src AS ({texts(documents)}),
{aws_cte}raw AS (SELECT id, type, severity, pattern, matched, strlen(substr(t, 1, cs))::INT AS position, strlen(substr(t, 1, ce))::INT AS "end", cs, ce FROM ({union})),
l AS (SELECT id, list({{'s': position, 'e': "end", 'type': type, 'severity': severity, 'pattern': pattern, 'matched': matched, 'cs': cs, 'ce': ce}} ORDER BY {order}) AS l FROM raw GROUP BY id),
k AS (SELECT id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM l),
kept AS (SELECT id, x.type AS type, x.severity AS severity, x.pattern AS pattern, x.matched AS matched, x.s AS position, x.e AS "end", x.cs AS cs, x.ce AS ce FROM (SELECT id, unnest(k) AS x FROM k))"""


def redaction(documents: bool = True, everything: bool = True) -> str:
    """CTEs of detection() and ``red``: id, sanitized_text, redacted_count, n_violations."""
    cases = lambda table, column, other: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"
    label = cases(rewrite.LABELS, "pattern", cases(rewrite.TYPE_LABELS, "type", "'[REDACTED]'"))
    return detection(documents, everything) + f""",
w AS (SELECT *, lag(ce, 1, 0) OVER (PARTITION BY id ORDER BY position) AS prev, CASE severity WHEN 'BLOCK' THEN {label} ELSE '[WARNING_' || upper(pattern) || ']' END AS new FROM kept WHERE severity IN ('BLOCK', 'WARN')),
p AS (SELECT w.id, string_agg(substr(src.t, prev + 1, cs - prev) || new, '' ORDER BY position) AS head, max(ce) AS last FROM w JOIN src USING (id) GROUP BY w.id),
c AS (SELECT id, count(*) AS n_violations, count(*) FILTER (WHERE severity IN ('BLOCK', 'WARN')) AS redacted_count FROM kept GROUP BY id),
red AS (SELECT src.id, coalesce(head || substr(t, last + 1), t) AS sanitized_text, coalesce(redacted_count, 0)::INT AS redacted_count, coalesce(n_violations, 0)::INT AS n_violations FROM src LEFT JOIN p USING (id) LEFT JOIN c USING (id))"""
