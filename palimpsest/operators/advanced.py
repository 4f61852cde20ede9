"""Detectors that normalise a candidate or check it: separators, confusable letters, escapes, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.checks import digits_of, iban_ok, luhn_ok
from palimpsest.functions.dialect import to_java
from palimpsest.sources.patterns import Pattern

from .spans import let, no_spans, placed_matches, regex_matches, span

#: Candidate expressions.
CARD = r"(?:\d[ -]?){13,19}"
PHONE = r"\+?\d(?:[\d\s().-]{6,}\d)"
IBAN = r"(?i)\b[a-z]{2}[0-9]{2}[a-z0-9 ]{11,40}\b"
IBAN_FORM = r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z"
PASSWORD = r"""(?i)\b([a-zA-Z0-9@._$!-]{3,32})\s*[:=]\s*("[^"]+"|'[^']+'|[^\s]+)"""
SPLIT_EMAIL = r"\b([A-Za-z0-9._%+-]{1,64})\s*(?:\+\s*)?@\s*([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
BASE64 = r"[A-Za-z0-9+/]{24,}={0,2}"
SIGNATURE = r"(?i)(?:\b(?:AKIA|ASIA)[0-9A-Z]{15,16}\b|\bsk-(?:[A-Za-z0-9]{48}|(?:proj|live|test)-[A-Za-z0-9_-]{20,})\b|postgres://|mongodb(?:\+srv)?://|mysql://|-----BEGIN (?:RSA|DSA|EC|OPENSSH) PRIVATE KEY-----)"
#: Phone forms in order of countries.
PHONE_FORMS = (
    ("nigerian_phone", r"\A(?:\+234\d{10}|0[789][01]\d{8})\z"),
    ("kenyan_phone", r"\A(?:\+254\d{9}|07\d{8})\z"),
    ("south_african_phone", r"\A(?:\+27\d{9}|0[6-8]\d{8})\z"),
    ("ghanaian_phone", r"\A(?:\+233\d{9}|0[2-5]\d{8})\z"),
)
#: Cyrillic letters and one Greek letter that look like the Latin letters below them.
CONFUSABLE = "аеорсхуіјАВЕКМНОРСТХΥ"
LATIN = "aeopcxyijABEKMHOPCTXY"
URI_PATTERNS = ("postgres_connection", "mongodb_connection", "mysql_connection")
MAX_DECODED = 4096

Loaded = dict[str, Pattern]


def _of(p: Pattern, matched: Column, position: Column, end: Column) -> Column:
    return span(p.type, p.severity, p.name, matched, position, end)


def _gated(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(no_spans())


def canonical_emails(text: Column, loaded: Loaded) -> Column:
    """E-mail addresses after percent decoding and folding of confusable letters; matched is the plain form."""
    p = loaded.get("email")
    if p is None:
        return no_spans()
    escapes = F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}"), F.lit(0))
    code = lambda u: F.conv(F.substring(u, 2, 2), 16, 10).cast("int")
    plain = F.transform(escapes, lambda u: F.when(code(u) < 128, F.char(code(u))).otherwise(F.lit("\x01")))
    between = F.split(text, "%[0-9A-Fa-f]{2}", -1)
    view = let(plain, lambda d: F.array_join(F.transform(between, lambda b, i: F.concat(F.translate(b, CONFUSABLE, LATIN), F.coalesce(F.get(d, i), F.lit("")))), ""))
    # A sign of three bytes for each three that are decoded: the view's characters with the text's bytes.
    bytes_ = F.regexp_replace(text, "%[0-9A-Fa-f]{2}", "\u2030")
    outer = lambda b: F.transform(placed_matches(view, p.java, size=F.length), lambda x: _of(p, x["matched"], F.octet_length(F.left(b, x["position"])), F.octet_length(F.left(b, x["end"]))))
    found = let(bytes_, outer)
    return _gated((F.contains(text, F.lit("@")) | F.contains(text, F.lit("%40"))) & text.rlike(r"%[0-9A-Fa-f]{2}|[^\x00-\x7F]"), found)


def phones(text: Column, loaded: Loaded) -> Column:
    """Phone numbers with separators, by the first country whose form fits."""
    wanted = [loaded[name] for name, _ in PHONE_FORMS if name in loaded]
    if not wanted:
        return no_spans()
    number = lambda x: F.concat(F.when(F.startswith(x["matched"], F.lit("+")), "+").otherwise(""), digits_of(x["matched"]))

    def country(x: Column) -> Column:
        name = F.lit(None).cast("string")
        for n, form in reversed(PHONE_FORMS):
            name = F.when(number(x).rlike(form), n).otherwise(name)
        return name

    def field(x: Column, what: str) -> Column:
        value = F.lit("")
        for p in wanted:
            value = F.when(x["country"] == p.name, getattr(p, what)).otherwise(value)
        return value

    candidates = F.transform(regex_matches(text, PHONE), lambda x: F.struct(x["matched"].alias("matched"), x["position"].alias("position"), x["end"].alias("end"), country(x).alias("country")))
    kept = F.filter(candidates, lambda x: x["country"].isin(*[p.name for p in wanted]))
    found = F.transform(kept, lambda x: span(field(x, "type"), field(x, "severity"), x["country"], x["matched"], x["position"], x["end"]))
    return _gated(text.rlike(r"\d[\d\s().-]{6,}\d"), found)


def separated_cards(text: Column, loaded: Loaded) -> Column:
    """Card numbers of 13 to 19 digits with separators that pass the Luhn check; the span keeps a separator at its end."""
    p = loaded.get("credit_card")
    if p is None:
        return no_spans()
    ok = lambda x: F.length(digits_of(x["matched"])).between(13, 19) & luhn_ok(digits_of(x["matched"]))
    found = F.transform(F.filter(regex_matches(text, CARD), ok), lambda x: _of(p, digits_of(x["matched"]), x["position"], x["end"]))
    return _gated(text.rlike(r"(?:\d[ -]?){13}"), found)


def canonical_ibans(text: Column, loaded: Loaded) -> Column:
    """IBANs in either case and with spaces whose check digits are right; matched is the compact form."""
    p = loaded.get("iban")
    if p is None:
        return no_spans()
    compact = lambda x: F.upper(F.replace(x["matched"], F.lit(" "), F.lit("")))
    ok = lambda x: compact(x).rlike(IBAN_FORM) & iban_ok(compact(x))
    found = F.transform(F.filter(regex_matches(text, IBAN), ok), lambda x: _of(p, compact(x), x["position"], x["end"]))
    return _gated(text.rlike("[A-Za-z][0-9]{2}"), found)


def password_assignments(text: Column, loaded: Loaded) -> Column:
    """Assignments to a key that spells a password word once look-alike characters are letters."""
    p = loaded.get("password_var")
    if p is None:
        return no_spans()
    key = lambda x: F.regexp_replace(F.translate(F.lower(x["g1"]), "@0$51!37", "aossiiet"), "[^a-z]", "")
    value = lambda x: F.regexp_replace(x["g2"], "\\A[\"']+|[\"']+\\z", "")
    ok = lambda x: key(x).isin("password", "passwd", "pwd") & (F.octet_length(value(x)) >= 8)
    found = F.transform(F.filter(regex_matches(text, PASSWORD, 2), ok), lambda x: _of(p, x["matched"], x["position"], x["end"]))
    # Every such key ends in a d, but for signs that are dropped.
    return _gated(text.rlike(r"[dD][^A-Za-z\s:=]{0,31}[\t\n\f\r ]*[:=]"), found)


def split_emails(text: Column, loaded: Loaded) -> Column:
    """Addresses with spaces or a plus sign around the at sign; matched is the address without them."""
    p = loaded.get("email")
    if p is None:
        return no_spans()
    ok = lambda x: F.contains(x["matched"], F.lit(" ")) | F.contains(x["matched"], F.lit("+"))
    found = F.transform(F.filter(regex_matches(text, SPLIT_EMAIL, 2), ok), lambda x: _of(p, F.concat(x["g1"], F.lit("@"), x["g2"]), x["position"], x["end"]))
    return _gated(F.contains(text, F.lit("@")), found)


def base64_secrets(text: Column) -> Column:
    """Base64 runs whose bytes show a credential."""
    data = lambda x: F.try_to_binary(x["matched"], F.lit("base64"))
    shown = lambda x: F.decode(data(x), "ISO-8859-1").rlike(to_java(SIGNATURE))
    ok = lambda x: (F.length(x["matched"]) % 4 == 0) & F.coalesce(F.octet_length(data(x)).between(1, MAX_DECODED) & shown(x), F.lit(False))
    found = F.transform(F.filter(regex_matches(text, BASE64), ok), lambda x: span("credential", "WARN", "base64_encoded_secret", x["matched"], x["position"], x["end"]))
    # Words are cut much faster than runs are looked for, and a run lies in one word.
    long = F.exists(F.split(text, " "), lambda w: F.octet_length(w) >= 24)
    return _gated(long & text.rlike("[A-Za-z0-9+/]{24}+"), found)


def escaped_uris(text: Column, loaded: Loaded) -> Column:
    """Connection strings that line breaks, tabs or their escapes interrupt; matched is the stretch as it stands."""
    patterns = [loaded[n] for n in URI_PATTERNS if n in loaded]
    if not patterns:
        return no_spans()
    dropped = r"\\[nrt]|[\n\r\t]"
    view = F.regexp_replace(text, dropped, "")

    def outer(x: Column, breaks: Column) -> Column:
        """A match of the view in the text's bytes: every break in front of it, and for its end every one within it, moves it on."""
        moved = lambda at, before: F.aggregate(breaks, at, lambda s, r: F.when(before(r["position"], s), s + r["end"] - r["position"]).otherwise(s))
        begin, end = moved(x["position"], lambda r, s: r <= s), moved(x["end"], lambda r, s: r < s)
        return F.struct(begin.alias("begin"), end.alias("end"))

    raw = text.cast("binary")
    slice_of = lambda o: F.substring(raw, o["begin"] + 1, o["end"] - o["begin"]).cast("string")

    def spans_of(p: Pattern, breaks: Column) -> Column:
        return F.transform(F.transform(placed_matches(view, p.java), lambda x: outer(x, breaks)), lambda o: _of(p, slice_of(o), o["begin"], o["end"]))

    spans = let(placed_matches(text, dropped), lambda breaks: F.concat(*[spans_of(p, breaks) for p in patterns]))
    broken = rf":(?:{dropped})*/(?:{dropped})*/"
    scheme = F.contains(text, F.lit("/")) & F.contains(text, F.lit(":"))
    return _gated(scheme & text.rlike(broken) & text.rlike(dropped) & view.rlike("(?:postgres|mongodb(?:\\+srv)?|mysql)://"), spans)


def advanced_spans(text: Column, loaded: Loaded) -> Column:
    return F.concat(
        canonical_emails(text, loaded), phones(text, loaded), separated_cards(text, loaded), canonical_ibans(text, loaded),
        password_assignments(text, loaded), split_emails(text, loaded), base64_secrets(text), escaped_uris(text, loaded),
    )
