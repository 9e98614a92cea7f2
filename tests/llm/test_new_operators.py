"""Operators 11 to 13 against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("cuelake.llm.queries")

from cuelake.llm import chat_format, jaccard_join, spelling, substring_dedup, turn_repair  # noqa: E402

# operator 11


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def variants(spark, rows, **options):
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, word string, n string"), **options)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def misspelt(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcdéßx")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


@pytest.mark.parametrize("hot", [spelling.HOT, 2])
def test_variants_agree_with_brute_force(spark, hot):
    rng = random.Random(11)
    known = ["station", "tion" * 3, "Éléphant", "abcdef", "abcdefg", "zzzzzz", "aaaaaaaa", "pronunciation", "größer" * 4]
    words = known * 200
    for w in known:
        for _ in range(12):
            v = misspelt(rng, w)
            words += [v] * rng.choice([4, 5, 6, 30])
            words += [misspelt(rng, v)] * rng.choice([5, 6])
    rng.shuffle(words)
    rows = [(k if k % 50 else None, rng.choice([" ", "-", "1", "\n"]).join(words[k::80]), "x", None) for k in range(80)]
    rows += [(900, None, None, None), (901, "", None, None), (902, "w" * 300_000, None, None), (None, "station " * 7, None, None), (None, "station " * 7, None, None)]
    want = brute_variants([r[:2] for r in rows])
    assert len(want) > 60 and any(form and form != root for form, root, *_ in want.values())
    assert variants(spark, rows, hot=hot) == want


def test_near_words_of_crowded_halves_are_all_found(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(250)}
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    for hot in (1, 10, 10_000):
        got = [frozenset((r.a, r.b)) for r in spelling.near_pairs(rows, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_words(spark):
    assert variants(spark, []) == {}
    assert variants(spark, [(1, "Short ones only, 12345678", None, None)]) == {}


# operator 12


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """The report of one conversation's rows: all results of edits are tried, a turn at a time, the best of each state kept with its texts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    count, seen, faults = Counter(), set(), []
    for _, _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
        count[faults[-1]] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {"": (0, "", ())}

    def offer(into, state, path):
        if state not in into or path[:2] < into[state][:2]:
            into[state] = path

    def inserted(now):
        for _ in range(4):
            for state, (cost, edits, out) in list(now.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if follows(state, c):
                        offer(now, c, (cost + 3, edits + "I", (*out, f"{name}:")))
        return now

    def follows(state, c):
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, edits, out) in inserted(best).items():
            offer(after, state, (cost + 4, edits + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a") and follows(state, role[:1]):
                offer(after, role[:1], (cost + more, edits + "K", (*out, f"{role}:{text}")))
            for c, name in (("u", "user"), ("a", "assistant")):
                if follows(state, c):
                    offer(after, c, (cost + 3 + more, edits + "R", (*out, f"{name}:{text}")))
        best = after
    cost, audit, out = min((p for s, p in inserted(best).items() if s in ("", "a")), key=lambda p: p[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_report(rows):
    by = defaultdict(list)
    for r in brute_damage(rows):
        by[r[0]].append(r)
    return {conv: brute_repair(by[conv]) for conv in {r[0] for r in rows}}


TURNS = "conv_id long, turn long, role string, text string, rows long, costs string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, **options):
    found = turn_repair.repair_report(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS), **options).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in found}


def some_turns(rng, conv, n):
    texts = ["Yes.", "No!", "and then", " \t", "", "Why?", "Ça va.", "x" * 50 + ". ", None]
    return [(conv, rng.choice([t, t, t, None, rng.randrange(n)]), rng.choice(["user", "assistant", "system", "tool", "user", "assistant", None, "", "User"]), rng.choice(texts) if rng.random() < 0.5 else f"t{t}.") for t in range(n)]


@pytest.mark.parametrize("piece,fan,sent", [(turn_repair.PIECE, turn_repair.FAN, turn_repair.BROADCAST_KEYS), (3, 2, 0)])
def test_repairs_agree_with_brute_force(spark, monkeypatch, piece, fan, sent):
    monkeypatch.setattr(turn_repair, "BROADCAST_KEYS", sent)
    rng = random.Random(12)
    rows = [r for conv in range(150) for r in some_turns(rng, conv if conv else None, rng.choice([1, 2, 3, 5, 8, 30]))]
    rows += [(500, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(400)]  # one long conversation
    rows += rows[:40]  # repeated rows
    assert repaired(spark, rows, piece=piece, fan=fan) == brute_report(rows)


def test_conversation_that_is_dropped_and_rows_without_turns(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:7".encode()) % 20 == 0)
    rows = [(gone, 7, "user", "Hi.")] + [(2000, None, "user", "Hello.")] * 1500 + [(2000, None, "assistant", f"{k}.") for k in range(1500)]
    rows += [(2001, 3, "user", "long " * 300_000), (2001, 4, "assistant", None)]
    got = repaired(spark, rows)
    assert got == brute_report(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark, []) == {}


# operator 13


def brute_repeats(rows, n=50):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words, strict=True):
        if k is not None:
            for i in range(len(w) - n + 1):
                first[tuple(w[i : i + n])] = min(k, first.get(tuple(w[i : i + n]), k))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - n + 1) if k is not None and first[tuple(w[i : i + n])] < k for j in range(n)}
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


PASSAGES = "doc_id long, text string, node string, key long, _spans int"


def repeats(spark, rows):
    found = substring_dedup.repeats_report(spark.createDataFrame([(*r, "a", 1, 2) for r in rows], PASSAGES)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr)


def passage_rows(rng):
    say = lambda n, k=3000: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared, short = say(90), say(45)
    rows = [(k, f"{say(rng.randrange(60))} {shared if k % 2 else short} {say(rng.randrange(60))}") for k in range(40)]
    rows += [(100 + k, rows[3][1]) for k in range(6)] + [(k, t) for k, t in rows[5:8]]  # copies, repeated rows
    words = shared.split()
    rows += [(200 + k, " ".join(words[: 40 + k]) + " " + say(70)) for k in range(20)]  # a beginning of which 40 to 59 words are shared
    rows += [(230 + k, say(30) + " " + " ".join(words[20:50] + [f"v{k // 2}"] + words[51:])) for k in range(8)]  # one word differs
    rows += [(300, "a " * 400), (301, "a b " * 150), (302, "a " * 120 + "c"), (250, "a " * 60)]  # windows that repeat in a text
    rows += [(400, None), (401, ""), (402, "   x"), (None, shared), (None, shared), (-5, say(20) + " " + shared + "\t\nend"), (403, say(30_000, 50) + " " + shared)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,shard_words", [(substring_dedup.HOT, substring_dedup.SHARD_WORDS), (2, 300), (0, 300)])
def test_repeats_agree_with_brute_force(spark, monkeypatch, hot, shard_words):
    monkeypatch.setattr(substring_dedup.find_repeats, "__defaults__", (substring_dedup.N, shard_words, hot))
    rows = passage_rows(random.Random(13))
    assert repeats(spark, rows) == brute_repeats(rows)


def test_places_join_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", 0)
    rows = passage_rows(random.Random(14))
    assert repeats(spark, rows) == brute_repeats(rows)


def test_texts_that_lose_nothing_stay(spark):
    shared = " ".join(f"x{k}" for k in range(60))
    rows = [(2, f"first  {shared}"), (1, shared + "\n last"), (3, "a\t b"), (4, None)]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], PASSAGES)
    got = substring_dedup.dedup_passages(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {2: "first", 1: rows[1][1], 3: "a\t b", 4: None}
    assert repeats(spark, []) == []


def test_matching_statistics():
    rng = random.Random(3)
    known = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    automaton = substring_dedup.SuffixAutomaton()
    for w in known:
        automaton.add([ord(c) for c in w])
    text = "".join(rng.choice("abcd") for _ in range(300))
    want = [max(n for n in range(i + 1) if n == 0 or any(text[i - n : i] in w for w in known)) for i in range(1, len(text) + 1)]
    assert automaton.matching([ord(c) for c in text]) == want

# operator 8: one order of shingles, however they are sent


def template_rows(rng, notes, ends):
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    template = say(60).split()
    rows = [" ".join(template[: rng.choice([10, 20, 30, 40])]) + " " + say(rng.choice([1, 2, 3, 5])) for _ in range(notes)]
    rows += [say(rng.choice([1, 2, 3])) + " " + " ".join(template[-rng.choice([10, 20, 30, 40]) :]) for _ in range(ends)]
    return rows + [r + " " + say(1) for r in rows[::3]]


def brute_jaccard_classes(texts, n=4):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("sent", [0, jaccard_join.COMMON_SENT])
def test_shared_templates_lose_no_link(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard_join, "COMMON_SENT", sent)
    rng = random.Random(17)
    texts = [t for k in range(6) for t in template_rows(rng, 40 + 5 * k, 40)]
    got = jaccard_join.jaccard_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == brute_jaccard_classes(texts)


def test_prefixes_are_the_same_by_broadcast_and_by_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 4)
    texts = [t for seed in range(300) for t in template_rows(random.Random(seed), 8, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = jaccard_join.set_signatures(docs).withColumn("node", jaccard_join.F.col("doc_id"))
    found = []
    for sent in (0, jaccard_join.COMMON_SENT):
        monkeypatch.setattr(jaccard_join, "COMMON_SENT", sent)
        rows = jaccard_join._prefixes(nodes, docs, 4, 85, 100).collect()
        found.append({r.node: (r.tokens, r.blocks, r.hot) for r in rows})
    assert len(found[0]) == len(texts) and found[0] == found[1]
    assert any(hot for *_, hot in found[0].values())


# operator 7: crowded parts


def brute_chat(rows, turns):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv, None if turn is None else turn // turns].append((turn is None, turn or 0, role or "unknown", (text or "").replace("<|im_", "<|_im_")))
    people = defaultdict(set)
    for (conv, _), found in by.items():
        people[conv] |= {r[2] for r in found} - {"system", "unknown"}
    for (conv, part), found in by.items():
        found.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        for piece in range(0, len(found), turns):
            for who in people[conv]:
                rendered, spans = "", []
                for _, _, speaker, content in found[piece : piece + turns]:
                    role = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                    rendered += f"<|im_start|>{role}\n"
                    spans += [f"{len(rendered)}-{len(rendered) + len(content)}"] if speaker == who else []
                    rendered += f"{content}<|im_end|>\n"
                out[conv, part, piece // turns, who] = (len(found[piece : piece + turns]), len(spans), rendered, ",".join(spans))
    return out


@pytest.mark.parametrize("sent", [chat_format.BROADCAST_KEYS, 0])
def test_chat_agrees_with_brute_force_where_turns_are_missing_or_repeat(spark, monkeypatch, sent):
    monkeypatch.setattr(chat_format, "TURNS", 16)
    monkeypatch.setattr(chat_format, "BROADCAST_KEYS", sent)
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 3, rng.randrange(60)]), rng.choice(["ann", "bob", "system", None, "cy"]), rng.choice(["same", f"t{k}", "é" * 5, None])) for k in range(900)]
    rows += [(5, None, "ann", "again")] * 1100 + [(6, 1, "bob", "x" * 50_000), (7, 2, None, "nobody")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.part, r.piece, r.perspective): (r.n_messages, r.n_masked, r.rendered, r.mask) for r in got} == brute_chat(rows, 16)
    assert len(got) == len(brute_chat(rows, 16))
