"""Turn reassembly against a plain simulation: late, repeated and rejected turns, long conversations, nulls."""

import hashlib

from tickerloom.llm import turns


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, n=8, idle=3):
    """Events of (conv_id, turn, role, text), conversation by conversation, batch by batch."""
    arrivals, first, out = {}, {}, []
    for c, t, role, text in rows:
        if t is None:
            continue
        role, text = role or "", text or ""
        h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
        first[c] = min(first.get(c, t), t)
        for b, r in [(h % n, role), *([((h + 3) % n, "user")] if h % 7 < 2 else [])]:
            got, new = arrivals.setdefault(c, {}).setdefault(b, {}), (f"{r}|{text}", r)
            if t not in got or new[0].encode() < got[t][0].encode():
                got[t] = new
    for c, batches in arrivals.items():
        kept, run, last, closed = {}, first[c], None, False
        for b in range(n + idle):
            got = batches.get(b, {})
            if closed:
                out += [("reject", _sha(p), c, t, b, None, None) for t, (p, _) in got.items()]
            elif got:
                last = b
                kept = got | kept
                while run in kept:
                    out.append(("release", _sha(kept[run][0]), c, run, b, None, None))
                    run += 1
            elif last is not None and b == last + idle:
                left = ",".join(str(t) for t in sorted(kept) if t >= run)
                breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
                out.append(("close", _sha(left), c, -1, min(b, n), max(kept) - first[c] + 1 - len(kept), breaks))
                closed = True
    return sorted(out, key=repr)


def test_events(spark, sf_dir, monkeypatch):
    """The table's conversations, with long ones over many parts and runs of parts, gaps, nulls and repeats."""
    monkeypatch.setattr(turns, "PART_BITS", 2)
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    roles = ["user", "assistant", "user", None]
    more = [(-1, t, roles[t % 4], f"long {t}") for t in range(-3, 90)]
    more += [(-2, t, roles[t % 3], f"gap {t}") for t in range(40) if t not in (17, 30)] + [(-3, t * 1000, "user", "far") for t in range(9)]
    more += [(-4, 2**40 + t, "user", "é|ü") for t in range(6)] + [(None, t, "user", "x") for t in range(7)]
    more += [(-5, None, "user", "x"), (-6, 0, None, None), (-6, 0, "user", "b"), (-6, 0, "user", "a"), (-6, 1, "", "")]
    rows = table + more
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, batch long, first string")
    got = [tuple(r) for r in turns.digest(frame).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == want
    assert {e[0] for e in want} == {"release", "reject", "close"} and sum(e[2] == -1 and e[0] == "release" for e in want) > 20


def test_empty_tables_and_batches(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.digest(none, 1).collect() == []
    arrivals = spark.createDataFrame([(1, 0, "user", "user|a", 0), (1, 1, "user", "user|b", 2)], "conv_id long, turn long, role string, payload string, batch int")
    got = turns.reassemble(arrivals, 3, idle=2).select("event", "turn", "batch", "payload", "n_breaks").collect()
    assert sorted(map(tuple, got)) == [("close", -1, 3, "", 1), ("release", 0, 0, "user|a", None), ("release", 1, 2, "user|b", None)]
