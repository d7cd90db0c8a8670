"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. High-recall generators (regular expressions) propose spans, which may overlap: the four base
   kinds (email, ip, card, phone), whose checks are exact and whose spans always stay, and looser
   kinds for what the base formats miss.
2. Boosted trees score each looser candidate from its format (length, digits, separators, Luhn,
   spread of characters) and its context (neighbouring characters, cue words before it).
3. Per kind, a probability threshold calibrated on held-out training rows selects the spans.

The trees are fitted once per driver on ``TRAIN_ROWS`` invented, labelled lines (a rule below
makes them; features come from the same expressions that score documents) and run as CASE
expressions. Positions come from two views of one match sequence: the pieces between matches
(``split``) and the matches (``regexp_extract_all``); their lengths, summed, give code points.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, calibrate, threshold
from .common import texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "mailtext", "secret", "ssn", "tel")
#: Labelled lines of the classifier's training set; half fit the trees, half calibrate them.
TRAIN_ROWS = 4000
#: Precision aimed at for each added kind on the calibration half.
PRECISION = 0.98

# Runs are possessive and start at a run's beginning (or at the end of the match before), which
# finds the same matches as the plain patterns without rescanning a long run from each character.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: kind -> (pattern, cheap test that a text must pass first)
GENERATORS = {
    "email": (_EMAIL, "contains({t}, '@')"),
    "ip": (_IP, "{t} rlike r'[0-9]\\.[0-9]'"),
    "card": (_DIGITS, "{t} rlike r'[0-9][\\x20-]?[0-9]'"),
    "phone": (_PHONE, "contains({t}, '+')"),
    "account": (_DIGITS, "{t} rlike r'[0-9][\\x20-]?[0-9]'"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "{t} rlike r'[A-Z]{{2}}[0-9]{{2}}'"),
    "mailtext": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[(\[{]?(?:at|AT)[)\]}]?\x20?[A-Za-z0-9-]{2,63}\x20?[(\[{]?(?:dot|DOT)[)\]}]?\x20?[A-Za-z]{2,12}(?![A-Za-z0-9])", "contains(lower({t}), 'dot')"),
    "secret": (r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_/+-])", "{t} rlike r'[A-Za-z0-9_-]{{20}}'"),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "{t} rlike r'[0-9]-[0-9]{{2}}-[0-9]'"),
    "tel": (r"(?<![0-9A-Za-z(+-])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", "{t} rlike r'[0-9]{{3}}[\\x20.-][0-9]{{3}}'"),
}
#: Words that announce personal data, lower case, by group (fixed values).
CUES = {
    "cue_number": ("account", "acct", "card", "customer", "konto", "compte", "cuenta", "member", "passport", "visa"),
    "cue_secret": ("token", "key", "secret", "password", "passwd", "bearer", "auth"),
    "cue_phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "cue_id": ("ssn", "social security", "iban", "tax id", "bank", "mail", "contact", "write to"),
}
CONTEXT = 28
#: Code points in a block of a text that is cut at many places; the step before cuts 16 blocks at once.
CUT = 4096
FEATURES = ["kind", "chars", "digits", "uppers", "lowers", "seps", "groups", "distinct", "luhn", "flips", "before", "after", *CUES]


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def found_sql(text: str, kind: str) -> str:
    """SQL array of struct(s, e, m): code-point start, end (exclusive) and text of each match.

    Starts are prefix sums taken in two levels (64 matches to a block), near linear in the matches.
    """
    pattern, test = GENERATORS[kind]
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    inside = total.format("slice(ad, cast(i div 64 as int) * 64 + 1, cast(i % 64 as int))")
    located = f"transform(ma, (m, i) -> named_struct('s', pre[cast(i div 64 as int)] + {inside} + length(pi[i]), 'm', m))"
    finished = f"transform({located}, x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'm', x.m))"
    prefix = f"transform(sequence(0, size(bl) - 1), b -> {total.format('slice(bl, 1, b)')})"
    blocks = f"transform(sequence(0, (size(ad) - 1) div 64), b -> {total.format('slice(ad, cast(b as int) * 64 + 1, 64)')})"
    steps = "transform(ma, (m, i) -> cast(length(pi[i]) + length(m) as bigint))"
    body = _let(steps, "ad", _let(blocks, "bl", _let(prefix, "pre", finished)))
    none = "cast(array() as array<struct<s:bigint,e:bigint,m:string>>)"
    parts = _let(f"split({text}, {_raw(pattern)}, -1)", "pi", body)
    matched = _let(f"regexp_extract_all({text}, {_raw(pattern)}, 0)", "ma", f"if(size(ma) = 0, {none}, {parts})")
    return f"if({test.format(t=text)}, {matched}, {none})"


def blocks_sql(text: str) -> str:
    """SQL array of a text's blocks of CUT code points, so that cutting out a piece does not walk from the text's start."""
    inner = _let(f"substring({text}, a * {16 * CUT} + 1, {16 * CUT})", "y", f"transform(sequence(0, greatest(length(y) - 1, 0) div {CUT}), b -> substring(y, cast(b as int) * {CUT} + 1, {CUT}))")
    return f"flatten(transform(sequence(0, cast(length({text}) div {16 * CUT} as int)), a -> {inner}))"


def cut_sql(blocks: str, start: str, stop: str) -> str:
    """SQL: the code points start..stop-1 (bigints) of a text given by its blocks."""
    first, last = f"cast(({start}) div {CUT} as int)", f"cast(({stop}) div {CUT} as int)"
    low, high = f"cast(({start}) % {CUT} as int)", f"cast(({stop}) % {CUT} as int)"
    within = f"substring(get({blocks}, {first}), {low} + 1, {high} - {low})"
    across = f"concat(substring(get({blocks}, {first}), {low} + 1), array_join(slice({blocks}, {first} + 2, {last} - {first} - 1), ''), coalesce(substring(get({blocks}, {last}), 1, {high}), ''))"
    return f"if(({stop}) <= ({start}), '', if({first} = {last}, {within}, {across}))"


def luhn_sql(digits: str) -> str:
    """SQL boolean: Luhn's check over a string of ASCII digits."""
    digit = f"cast(substring(if((length({digits}) - i) % 2 = 1, translate({digits}, '0123456789', '0246813579'), {digits}), i, 1) as int)"
    return f"(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + {digit}) % 10 = 0)"


_ONLY_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, r'\\.'), q -> length(regexp_replace(q, '^0+', '')) <= 3 and cast(right(concat('0', regexp_replace(q, '^0+', '')), 3) as int) <= 255)",
    "card": _let(_ONLY_DIGITS, "d", f"length(d) between 13 and 19 and {luhn_sql('d')}"),
    "phone": f"length({_ONLY_DIGITS}) between 9 and 15",
    # a verified card is no further account
    "account": _let(_ONLY_DIGITS, "d", f"length(d) between 8 and 24 and not (length(d) between 13 and 19 and {luhn_sql('d')})"),
}


def base_sql(text: str, kind: str) -> str:
    """SQL array of the kind's verified spans, struct(k, s, e); failing matches are dropped."""
    kept = found_sql(text, kind) if CHECKS[kind] == "true" else f"filter({found_sql(text, kind)}, x -> {CHECKS[kind]})"
    return f"transform({kept}, x -> named_struct('k', '{kind}', 's', x.s, 'e', x.e))"


def features_sql(text: str, kind: str, blocks: str = "bl") -> str:
    """SQL array of the kind's candidates with their features; ``blocks`` holds the text's blocks."""
    number = "cast({} as double)"
    without = lambda cls: f"length(regexp_replace(x.m, '[^{cls}]', ''))"
    before = f"lower({cut_sql(blocks, f'greatest(x.s - {CONTEXT}, 0L)', 'x.s')})"
    values = {
        "kind": str(ADDED.index(kind)),
        "chars": "length(x.m)",
        "digits": without("0-9"),
        "uppers": without("A-Z"),
        "lowers": without("a-z"),
        "seps": without(" ./()_-"),
        "groups": "size(split(x.m, '[^0-9A-Za-z]+'))",
        "distinct": "size(array_distinct(split(lower(x.m), '')))",
        "luhn": f"if(length({_ONLY_DIGITS}) between 8 and 24 and {luhn_sql(_ONLY_DIGITS)}, 1, 0)",
        "flips": "size(split(x.m, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])'))",
        "before": "if(right(cx, 1) rlike r'[0-9a-z_.,:/-]', 1, 0)",
        "after": f"if({cut_sql(blocks, 'x.e', 'x.e + 1')} rlike r'[0-9A-Za-z_/-]', 1, 0)",
        **{name: "if(" + " or ".join(f"contains(cx, '{c}')" for c in cues) + ", 1, 0)" for name, cues in CUES.items()},
    }
    row = ", ".join(f"'{n}', {number.format(values[n])}" for n in FEATURES)
    struct = f"named_struct('k', '{kind}', 's', x.s, 'e', x.e, {row})"
    kept = found_sql(text, kind) if kind not in CHECKS else f"filter({found_sql(text, kind)}, x -> {CHECKS[kind]})"
    return f"transform({kept}, x -> {_let(before, 'cx', struct)})"


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, low: int = 2, high: int = 9) -> str:
    return "".join(r.choice("aeiounrstlhd") for _ in range(r.randint(low, high)))


def _line(r: random.Random) -> tuple[str, str, int]:
    """One invented line: the text, the kind whose candidate it holds, and whether that is personal data."""
    kind, good = r.choice(ADDED), r.randint(0, 1)
    alphabet = r.choice(("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    cue = {"account": "cue_number", "secret": "cue_secret", "tel": "cue_phone"}.get(kind, "cue_id")
    lead = r.choice(CUES[cue]) if good and r.random() < 0.5 else _word(r)
    if kind == "account":
        n = r.choice((13, 14, 15, 16, 16, 16, 16, 17, 18, 19)) if good else r.choice((8, 8, 9, 10, 11, 12, 22, 24, 14))
        d = _digits(r, n)
        if not good and r.random() < 0.5:
            d = f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + (f" {r.randint(10, 23)}" if r.random() < 0.3 else "")
        elif good and r.random() < 0.3:
            d = " ".join(d[i : i + 4] for i in range(0, n, 4))
        elif not good:
            lead = r.choice(("total", "page", "isbn", "order", "population", _word(r), _word(r)))
        body = d
    elif kind == "iban":
        body = r.choice(("DE", "FR", "ES", "GB", "NL")) + _digits(r, 2)
        body += _digits(r, 16) if good else "".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(16))
        if r.random() < 0.5:
            body = " ".join(body[i : i + 4] for i in range(0, len(body), 4))
    elif kind == "mailtext":
        open_, shut = r.choice((("(", ")"), ("[", "]"), ("{", "}"), (" ", " ")))
        if good:
            body = f"{_word(r)}.{_word(r)}{open_}at{shut}{_word(r)}{open_}dot{shut}" + r.choice(("com", "org", "net", "de", "fr"))
        else:
            body = f"{_word(r)} at {_word(r, 2, 4)} dot {_word(r, 4, 12)}"
            lead = _word(r)
    elif kind == "secret":
        n = r.choice((20, 24, 32, 40, 40, 48, 64, r.randint(100, 512), r.randint(513, 3000)))
        body = "".join(r.choice(alphabet) for _ in range(n))
        if not good:
            body = r.choice((_word(r, 20, 40), "-".join(_word(r) for _ in range(6)), "_".join(_word(r) for _ in range(6)), "-" * 30, _digits(r, 30), "x" * 25, _word(r, 22, 28) + "2", "A" * 22))
            if r.random() < 0.2:
                n = r.randint(100, 3000)
                body = r.choice((_word(r, n, n), "-".join(_word(r) for _ in range(n // 6)), "_".join(_word(r) for _ in range(n // 6)), "-" * n, _digits(r, n), "x" * n, "A" * n))
    elif kind == "ssn":
        body = f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
        if good:
            lead = r.choice((*CUES["cue_id"], _word(r)))
        else:
            lead = r.choice(("part", "no.", "item", "range"))
    else:
        body = r.choice((f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 4)}"))
        if not good:
            body = r.choice((f"{r.randint(10, 99)}/{_digits(r, 4)}-{_digits(r, 4)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}"))
            lead = r.choice(("sum", "total", "range", _word(r)))
    join = r.choice((" ", ": ", ' = "', " ")) if kind == "secret" else r.choice((" ", ": ", " "))
    tail = '"' if join.endswith('"') else ""
    if kind == "secret" and good and r.random() < 0.7:
        lead = r.choice(CUES["cue_secret"])
    return f"{_word(r)} {_word(r)} {lead}{join}{body}{tail} {_word(r)} {_word(r)}.", kind, good


def _every(text: str) -> str:
    """SQL array of all candidates of the added kinds in a text."""
    return _let(blocks_sql(text), "bl", "concat(" + ", ".join(features_sql(text, k) for k in ADDED) + ")")


@functools.lru_cache(maxsize=4)
def fitted(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 11) -> tuple[Boosted, dict[str, float], tuple[float, float]]:
    """The trees, thresholds by kind, and the calibration, from invented lines."""
    r = random.Random(seed)
    lines = [dict(zip(("text", "kind", "good"), _line(r), strict=True)) for _ in range(rows)]
    source = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(lines)), "array<struct<text:string,kind:string,good:int>>")).alias("l")).select("l.*")
    columns = [F.col(f"c.{f}") for f in FEATURES]
    candidates = source.select(F.col("kind").alias("of"), "good", F.explode(F.expr(_every("text"))).alias("c"))
    got = candidates.where("c.k = of").select(*columns, "c.k", "good").collect()
    x = np.array([[row[f] for f in FEATURES] for row in got], float)
    y, kinds = np.array([row.good for row in got], float), np.array([row.k for row in got])
    fit = np.arange(len(y)) % 2 == 0
    model = Boosted().fit(x[fit], y[fit])
    margin = model.margin(x[~fit])
    a, b = calibrate(margin, y[~fit])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    limits = {k: threshold(p[kinds[~fit] == k], y[~fit][kinds[~fit] == k], PRECISION) for k in ADDED}
    return model, limits, (a, b)


def added_sql(spark: SparkSession, text: str) -> str:
    """SQL array of the selected spans of the added kinds, struct(k, s, e)."""
    model, limits, (a, b) = fitted(spark)
    chance = f"1 / (1 + exp(-({a:.9f}D * ({model.sql([f'c.{f}' for f in FEATURES])}) + {b:.9f}D)))"
    limit = "case c.k " + " ".join(f"when '{k}' then {limits[k]:.9f}D" for k in ADDED) + " end"
    return f"transform(filter({_every(text)}, c -> {chance} >= {limit}), c -> named_struct('k', c.k, 's', c.s, 'e', c.e))"


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``pii_spans``: arrays of struct(k, s, e) by kind, then start.

    Positions are code points, the end exclusive. Base kinds: email, ip (parts at most 255), card
    (13 to 19 digits passing Luhn), phone (9 to 15 digits), leftmost and non-overlapping within a
    kind. ``pii_spans`` holds these and the boosted selection of looser candidates; spans of
    different kinds may overlap.

    Defined results: a null or empty text has no spans; repeated rows are each searched; other
    columns pass through (those named like the two new ones are replaced); an empty table gives an
    empty table; texts of any length are searched whole, in time near linear in the text and its
    candidates. No shuffle, no Python.
    """
    spark = docs.sparkSession
    # the row travels as one column, so that no name of its own can clash with those used here
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    out = out.withColumns({f"_{k}": F.expr(base_sql("_t", k)) for k in BASE})
    added = F.expr(added_sql(spark, "_t"))
    # all looser kinds need one of these; most texts hold none and skip their generators
    hint = F.expr(r"_t rlike r'[0-9]{2}|[A-Za-z0-9_-]{20}' or contains(lower(_t), 'dot')")
    out = out.withColumn("base_spans", F.concat(*[f"_{k}" for k in BASE]))
    out = out.withColumn("pii_spans", F.when(hint, F.concat("base_spans", added)).otherwise(F.col("base_spans")))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("base_spans", "pii_spans")]
    return out.select(*kept, "base_spans", "pii_spans")


def redact_sql(text: str, spans: str) -> str:
    """SQL: the text with every covered stretch replaced by the kind (upper case) of its first span.

    In the order of their starts, a span opens a stretch if it begins at or after the end of all before it;
    those ends are greatest values taken in two levels, 64 spans to a block.
    """
    ordered = f"sort_array(transform({spans}, x -> named_struct('s', x.s, 'ne', -x.e, 'k', x.k)))"
    most = "coalesce(array_max({}), 0L)"
    inside = most.format("slice(es, cast(i div 64 as int) * 64 + 1, cast(i % 64 as int))")
    opened = f"filter(transform(o, (x, i) -> named_struct('s', x.s, 'k', x.k, 'at', greatest(pre[cast(i div 64 as int)], {inside}))), x -> x.s >= x.at)"
    pieces = f"transform({opened}, x -> concat({cut_sql('bl', 'x.at', 'x.s')}, '<', upper(x.k), '>'))"
    body = f"concat(array_join({pieces}, ''), {cut_sql('bl', 'array_max(es)', f'cast(length({text}) as bigint)')})"
    blocks = f"transform(sequence(0, (size(es) - 1) div 64), b -> {most.format('slice(es, cast(b as int) * 64 + 1, 64)')})"
    prefix = f"transform(sequence(0, size(mb) - 1), b -> {most.format('slice(mb, 1, b)')})"
    body = _let(blocks, "mb", _let(prefix, "pre", _let(blocks_sql(text), "bl", body)))
    return f"if(size({spans}) = 0, {text}, {_let(ordered, 'o', _let('transform(o, x -> -x.ne)', 'es', body))})"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``<KIND>``; a null text stays null.

    Same columns, same rows. Overlapping spans are replaced as one stretch.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_spans(whole).withColumn("text", F.expr(redact_sql("text", "pii_spans")))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of base kinds, the digest of the base spans, and all spans as text."""
    found = find_spans(texts(docs))
    shown = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')")
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("pii_spans").alias("spans"))
