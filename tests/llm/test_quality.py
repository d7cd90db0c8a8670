import collections
import re

from tickerloom.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(x):
    x = x or ""
    w = re.findall(WORD, x)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x.count(s) for s in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_counts(spark, frame, odd_rows):
    more = [(100, "a b c d e f g h " * 3), (101, "a b c d e f g h i " + " ".join(map(str, range(30))) + " a b c d e f g h x b c d e f g h i"), (102, "x\ny\nx\n \n \nx # | <b>")]
    got = quality.report(frame([*odd_rows, *more], clash=True)).collect()
    shown = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert shown == sorted(brute(r[1]) for r in [*odd_rows, *more])
    assert quality.report(frame(odd_rows).limit(0)).count() == 0


def test_lines(spark, frame):
    prose = "This is a perfectly normal line of prose that goes on for a while and then ends as it should. " * 2
    nav = "Home | About | News | Contact | Login"
    rows = [(1, f"{prose}\n{nav}\nAll rights reserved."), (2, "\n".join([f"{nav} {i}" for i in range(20)])), (3, prose), (4, prose + "\n" + "=" * 50)]
    got = {r.doc_id: r for r in quality.quality(frame(rows)).collect()}
    assert got[1].kept is True or got[1].base_failed
    assert got[1].cleaned == prose and got[1].n_removed_lines == 2 and not got[2].kept and got[3].n_removed_lines == 0 and got[4].cleaned == prose


def test_common_lines(spark, frame):
    """A line of many unlike documents goes, in any language; lines of copies and near copies stay."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 12)))
    prose = lambda n: " ".join(word() for _ in range(n))
    notice = "Alle Rechte sind dem Verlag vorbehalten, Ausgabe {}"
    rows = [(i, f"{prose(30)}\n{notice.format(i)}\n{prose(30)}") for i in range(40)]
    copy = [prose(12) for _ in range(8)]
    for i in range(60):
        lines = list(copy)
        for _ in range(3):
            k = r.randrange(8)
            words = lines[k].split(" ")
            words[r.randrange(len(words))] = word()
            lines[k] = " ".join(words)
        rows.append((100 + i, "\n".join(lines)))
    rows += [(200 + i, "\n".join(copy)) for i in range(60)]
    df = frame(rows)
    common = quality.common_lines(df)
    assert len(common) == 1 and common == [x.h for x in df.limit(1).selectExpr(f"xxhash64({quality.plain_line_sql(repr(notice.format(1)))}) as h").collect()]
    got = {x.doc_id: x for x in quality.quality(df, common=common).collect()}
    assert all(got[i].n_removed_lines == 1 and notice.format(i) not in got[i].cleaned and got[i].kept for i in range(40))
    assert all(x.n_removed_lines == 0 and x.kept for i, x in got.items() if i >= 100)
    assert quality.common_lines(df.limit(0)) == []


def test_no_python_in_plan(spark, frame):
    plan = quality.report(frame([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
