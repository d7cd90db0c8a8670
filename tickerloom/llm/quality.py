"""Quality rules, line first, in DataFrame functions only.

Every line is judged by three rules: *punctuation* (hardly a letter in it, or mostly
punctuation), *navigation* (a run of short cells between separators) and *boilerplate* (in a line of
notice length, a notice phrase, or the line itself being common in the corpus). Failing lines are
removed; a document that loses more than ``max_lost`` of the characters in its lines is rejected.
Document counts (words, symbols, repeated lines and 8-word windows) come from the whole text.

Common lines are found in the corpus itself, so in any language: short lines that stand in many
documents of many kinds. A document's kind is how its longest line begins, which nearly all near
copies agree in; so the lines of a group of copies, however large, are not common for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words in a window of the repetition count.
WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows beyond which a document fails.
MAX_REPEAT = 30
#: Share of line characters that may be removed.
MAX_LOST = 0.5
#: Words beyond which a line with a notice phrase counts as prose.
NOTICE_WORDS = 40
#: Phrases of notices, lower case.
NOTICES = (
    "all rights reserved",
    "cookie",
    "copyright ©",
    "enable javascript",
    "privacy policy",
    "terms of service",
    "terms of use",
    "is licensed under",
    "subscribe to our newsletter",
    "click here to",
)

#: A common line stands in documents of at least this many kinds, and as many as one in so many of all
#: documents; and its documents are no more than so many a kind.
LEAST_COMMON = 10
COMMON_SHARE = 1000
A_KIND = 4
#: Characters of a short line, and of the beginning that tells a kind.
SHORT_LINE = 300
KIND_CHARS = 24

_SPACE = r"\x20\x09-\x0D"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(text: str = "text") -> str:
    return f"filter(split({text}, r'[{_SPACE}]+'), w -> w <> '')"


def repeat_words_sql(words: str) -> str:
    """Words that lie in a window of eight found at least twice, from an array of words.

    Window hashes are compared; only where two agree are they sorted with their positions, and the
    union of the windows is measured in one pass from left to right.
    """
    window = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    hashes = f"if(size(h) < {WINDOW}, array(), transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({window})))"
    twice = "filter(transform(s, (e, k) -> if((k > 0 and s[k - 1].x = e.x) or (k < size(s) - 1 and s[k + 1].x = e.x), e.p, null)), p -> p is not null)"
    union = f"aggregate(sort_array({twice}), named_struct('n', 0L, 'end', 0L), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.end, p), 'end', p + {WINDOW}), a -> a.n)"
    measured = _let("sort_array(transform(v, (x, i) -> named_struct('x', x, 'p', cast(i as bigint))))", "s", union)
    per_text = _let(hashes, "v", f"if(size(array_distinct(v)) = size(v), 0L, {measured})")
    return _let(f"transform({words}, w -> xxhash64(w))", "h", per_text)


def plain_line_sql(line: str) -> str:
    """SQL: the line in lower case, with numbers and white space made alike."""
    return f"trim(regexp_replace(regexp_replace(lower({line}), '[0-9]+', '0'), r'[{_SPACE}]+', ' '))"


def common_lines(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Hashes of the common lines of ``docs``, ascending.

    Two rounds of sums: documents by line and kind, then kinds by line, so that a line in a large share of
    all documents is spread over its kinds first. The driver gets at most ``COMMON_SHARE`` times the
    mean number of short lines in a document.
    """
    least = max(LEAST_COMMON, -(-docs.count() // COMMON_SHARE))
    rows = docs.select(F.expr(f"filter(split(coalesce(cast(`{text_col}` as string), ''), '\\n'), l -> l rlike r'[^{_SPACE}]')").alias("ls"))
    kind = f"array_max(transform(ls, l -> named_struct('n', length(l), 't', left(l, {KIND_CHARS})))).t"
    plain = f"array_distinct(transform(filter(ls, l -> length(l) <= {SHORT_LINE}), l -> xxhash64({plain_line_sql('l')})))"
    found = rows.select(F.expr(f"xxhash64({kind})").alias("kind"), F.explode(F.expr(plain)).alias("line"))
    lines = found.groupBy("line", "kind").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    return sorted(r.line for r in lines.where((F.col("kinds") >= least) & (A_KIND * F.col("kinds") >= F.col("n"))).select("line").collect())


def line_fails(line: str, common: list[int] | None = None) -> str:
    """SQL boolean: the line (which has a word) fails a rule."""
    letters = rf"length(regexp_replace({line}, '[^\\p{{L}}\\p{{N}}]+', ''))"
    solid = f"length(regexp_replace({line}, r'[{_SPACE}]+', ''))"
    punctuation = f"({letters} * 2 < {solid})"
    cells = f"size(split({line}, '[|»›·•]|&gt;|  +'))"
    n_words = f"size({words_sql(line)})"
    navigation = f"({cells} >= 4 and {n_words} <= 4 * {cells})"
    notice = " or ".join(f"contains(lower({line}), '{p}')" for p in NOTICES)
    known = f" or (length({line}) <= {SHORT_LINE} and xxhash64({plain_line_sql(line)}) in ({', '.join(f'{h}L' for h in common)}))" if common else ""
    return f"({punctuation} or {navigation} or (({notice}) and {n_words} <= {NOTICE_WORDS}){known})"


def quality(docs: DataFrame, max_lost: float = MAX_LOST, text_col: str = "text", common: list[int] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_removed_lines, line_chars, kept_chars, kept and ``cleaned`` (the text without its failing lines).

    Words are runs of characters other than space and 0x09-0x0D. A text fails at once with fewer
    than 20 words or with more than 30 % of its words in repeated windows; otherwise it is kept
    unless more than ``max_lost`` of the characters of its lines (those with a word) were removed.
    ``common`` is what ``common_lines`` has found.

    Defined results: a null text counts as empty: all counts 0, failed, not kept, cleaned empty;
    repeated rows are judged each alike; other columns pass through (those with a name given above
    are replaced); an empty table gives an empty table; texts of any length are judged whole, in
    time linear in the length but for sorting windows of repetitive texts. No shuffle.
    """
    words, lines = words_sql("_text"), f"filter(split(_text, '\\n'), l -> l rlike r'[^{_SPACE}]')"
    per_words = _let(words, "ws", f"named_struct('n', cast(size(ws) as bigint), 'chars', aggregate(ws, 0L, (a, w) -> a + length(w)), 'repeat', {repeat_words_sql('ws')})")
    measured = "aggregate(ls, named_struct('n', 0L, 'chars', 0L, 'lost_n', 0L, 'lost', 0L), (a, l) -> if(l.bad, named_struct('n', a.n + 1, 'chars', a.chars + l.c, 'lost_n', a.lost_n + 1, 'lost', a.lost + l.c), named_struct('n', a.n + 1, 'chars', a.chars + l.c, 'lost_n', a.lost_n, 'lost', a.lost)))"
    judged = f"transform({lines}, l -> named_struct('bad', {line_fails('l', common)}, 'c', cast(length(l) as bigint)))"
    per_lines = _let(lines, "fl", "cast(size(fl) - size(array_distinct(fl)) as bigint)")
    # the row travels as one column, so that no name of its own can clash with those used here
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    out = out.withColumn("_w", F.expr(per_words)).withColumn("_l", F.expr(_let(judged, "ls", measured)))
    n, repeat = F.col("_w.n"), F.col("_w.repeat")
    failed: Column = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n)
    added = {
        "n_words": n,
        "word_chars": F.col("_w.chars"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.expr(per_lines),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "n_lines": F.col("_l.n"),
        "n_removed_lines": F.col("_l.lost_n"),
        "line_chars": F.col("_l.chars"),
        "kept_chars": F.col("_l.chars") - F.col("_l.lost"),
        "kept": ~failed & (F.col("_l.lost") <= F.lit(float(max_lost)) * F.col("_l.chars")),
        "cleaned": F.expr(f"array_join(filter(split(_text, '\\n'), l -> not (l rlike r'[^{_SPACE}]') or not {line_fails('l', common)}), '\\n')"),
    }
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return out.select(*kept, *[c.alias(name) for name, c in added.items()])


def report(docs: DataFrame) -> DataFrame:
    """The counts and verdicts of ``quality`` per document, without texts; the common lines are those of ``docs``."""
    out = quality(texts(docs), common=common_lines(docs))
    return out.drop("text", "cleaned")
