"""Captions from frames against plain loops."""

from __future__ import annotations

import difflib
import random
import re

from cuelake.plans import burned

BOX = "struct<left:double,top:double,width:double,height:double>"
FRAMES = f"media_id long, cue long, frame long, at_ms long, source string, target string, source_box {BOX}, target_box {BOX}"


def plain(x):
    return re.sub(r"[^\w㐀-鿿]+", "", (x or "").casefold())


def like(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def steadiness(expected, texts, boxes):
    want, seen = plain(expected), [plain(t) for t in texts]
    if not want or not any(seen):
        return None
    near = [like(a, b) for a, b in zip(seen, seen[1:]) if a and b]
    there = [b for b in boxes if b]
    moved = [overlap(a, b) for a, b in zip(there, there[1:])]
    longest = run = 0
    for x in seen:
        run = run + 1 if x and like(want, x) >= 0.78 else 0
        longest = max(longest, run)
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return round(0.4 * mean(near) + 0.3 * sum(map(bool, seen)) / len(seen) + 0.2 * mean(moved) + 0.1 * min(1.0, longest / 3), 6)


def most_like_all(texts):
    """The reading most like all of them, then the longest, then the first."""
    said = [(k, t.strip()) for k, t in enumerate(texts) if (t or "").strip()]
    if not said:
        return ""
    first = {}
    for k, t in said:
        first.setdefault(plain(t), (k, t))
    total = {p: round(sum(like(p, plain(t)) for _, t in said), 9) for p in first}
    return first[max(first, key=lambda p: (total[p], len(p), -first[p][0]))][1]


def plain_captions(cues, frames):
    out = {}
    for media in {c[0] for c in cues}:
        rows = []
        for _, pos, start, end in (c for c in cues if c[0] == media):
            mine = sorted((f for f in frames if f[0] == media and f[1] == pos), key=lambda f: (f[3], f[2]))
            for k, f in enumerate(mine):
                low = start if k == 0 else (mine[k - 1][3] + f[3]) // 2
                high = end if k + 1 == len(mine) else (f[3] + mine[k + 1][3]) // 2
                if high > low and (plain(f[4]) or plain(f[5])):
                    rows.append((low, high, f[2], *f[4:]))
        rows.sort(key=lambda r: r[:3])
        made = []
        for r in rows:
            s, t = plain(r[3]), plain(r[4])
            if made:
                a, b = plain(made[-1][0][3]), plain(made[-1][0][4])
                if (s, t) == (a, b) or (like(a, s) >= 0.78 and like(b, t) >= 0.78):
                    made[-1].append(r)
                    continue
            made.append([r])
        for pos, run in enumerate(made, 1):
            run.sort(key=lambda r: r[2])
            source, target = most_like_all([r[3] for r in run]), most_like_all([r[4] for r in run])
            out[media, pos] = (min(r[0] for r in run), max(r[1] for r in run), len(run), source, target, steadiness(source, [r[3] for r in run], [r[5] for r in run]), steadiness(target, [r[4] for r in run], [r[6] for r in run]))
    return out


def test_captions_from_frames(spark):
    rng = random.Random(9)
    said = ["Bonjour tout le monde", "Il est tard, rentrons", "Où est le chat ?", "你好世界再见"]
    cues, frames = [], []
    for media in (1, 2, 3):
        at = 0
        for pos in range(1, 13):
            end = at + rng.choice([400, 1500, 3000])
            cues.append((media, pos, at, end))
            text = rng.choice(said)
            for k in range(rng.choice([1, 2, 3, 4])):
                read = "".join(rng.choice("xyz") if rng.random() < 0.08 else c for c in text)
                box = rng.choice([None, (float(rng.randrange(4)), 1.0, 20.0, 5.0)])
                frames.append((media, pos, len(frames), rng.randrange(at, end), rng.choice([read, read, read, "", None]), rng.choice(["hello there", "hello there!", "late now", None]), box, box))
            at = end + rng.choice([0, 700])
    rows = spark.createDataFrame(frames, FRAMES)
    got = burned.extracted(spark.createDataFrame(cues, "media_id long, pos long, start_ms long, end_ms long"), rows).collect()
    want = plain_captions(cues, frames)
    assert {(r.media_id, r.pos): (r.start_ms, r.end_ms, r.n, r.source, r.target, r.source_stability, r.target_stability) for r in got} == want
    assert len(got) == len(want) > 20
    none = burned.extracted(spark.createDataFrame(cues, "media_id long, pos long, start_ms long, end_ms long"), rows.limit(0))
    assert none.count() == 0


def test_times_where_another_frame_helps(spark):
    frames = [(1, 1, 0, 0, "a", "x", None, None), (1, 1, 1, 600, "b", "x", None, None), (1, 1, 2, 900, "c", "x", None, None), (1, 1, 3, 2000, "C!", "x", None, None), (1, 2, 4, 3000, "d", None, None, None), (1, 2, 5, 4001, None, None, None, None)]
    got = burned.refinements(spark.createDataFrame(frames, FRAMES)).collect()
    assert sorted((r.cue, r.at_ms) for r in got) == [(1, 300), (2, 3500)]


# the second review strategy


def test_forms_of_terms_are_clustered(spark):
    from cuelake.plans import strategy

    rows = [
        (1, "ann", "Ann", "Anna", "person", "low", [1, 2, 3]), (1, "ann", "ann", "Anne", "person", "high", [9]), (1, "annie", "Annie", "Anne", "person", "medium", [9, 10]), (1, "bob", "Bob", "Bob", "person", "high", [4]),
        (1, "rob", "Rob", "Bob", "person", "high", [5]), (2, "ann", "Ann", "Ana", "person", "high", [1]),
    ]
    terms = spark.createDataFrame(rows, "media_id long, low string, source string, target string, type string, confidence string, evidence array<long>")
    got = strategy.clustered(terms).collect()
    by = {}
    for r in got:
        by.setdefault((r.media_id, r.cluster), set()).add((r.low, r.target, r.canonical))
    assert sorted(map(sorted, by.values())) == [
        [("ann", "Ana", "Ana")], [("ann", "Anna", "Anne"), ("ann", "Anne", "Anne"), ("annie", "Anne", "Anne")], [("bob", "Bob", "Bob")], [("rob", "Bob", "Bob")],
    ]
    assert strategy.clustered(terms.limit(0)).count() == 0


def test_windows_share_a_budget(spark):
    from cuelake.plans import strategy

    rows = [(1, 1, 3, 1), (1, 5, 6, 0), (1, 9, 9, 0), (1, 12, 20, 1), (2, 1, 9, 0)]
    got = strategy.within_budget(spark.createDataFrame(rows, "media_id long, first_pos long, last_pos long, priority int"), 6).collect()
    assert {(r.media_id, r.first_pos): r.taken for r in got} == {(1, 5): True, (1, 9): True, (1, 1): True, (1, 12): False, (2, 1): False}
