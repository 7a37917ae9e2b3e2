"""Phrases, conversation repair and packing: brute force, the tokenizers library, and odd tables."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemolake.llm import bpe, packing, phrases, repair
from test_documents import CLASHING, odd_rows, table_of

# --- phrases --------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top, covered=80):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(8)
    words = "the of And a stone, walks. under quiet; blue engine\t\tmaps early é 中文 x\x0by".split(" ")
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", None, "fr"]), "s", 1) for i in range(120)]
    return rows + odd_rows() + [(500, "in the beginning there was " * 40, "en", "s", 1)] * 2


@pytest.mark.parametrize("full, burst, step", [(1_000_000, 4096, 1 << 19), (40, 3, 7)])
def test_phrases_as_brute_force(spark, monkeypatch, full, burst, step):
    rows = phrase_rows()
    docs = table_of(spark, rows, wide=True).repartition(3)
    if step < 100:  # spills, bursts and slices; the functions run in this process for it
        for name, value in (("FULL", full), ("BURST", burst), ("STEP", step), ("WORDS", 50)):
            monkeypatch.setattr(phrases, name, value)
        for sizes in ((1,), (2,), (3, 4), (1, 2, 3, 4)):
            counting, got = phrases.Counting("en", sizes, None, None), Counter()
            texts = [r[1] or "" for r in rows]
            for batch in [*counting.read(texts), *counting.runs(True)]:
                assert batch.column("phrase").to_pylist() == sorted(batch.column("phrase").to_pylist(), key=str.encode)
                for phrase, f in zip(*(batch.column(c).to_pylist() for c in ("phrase", "f"))):
                    got[phrase] += f
            want = Counter()
            for text in texts:
                for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                    words = re.findall("[^ \t]+", piece)
                    want.update(" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1))
            assert got == want
        return
    got = phrases.collocations(docs, least=6, top=50).collect()
    want = plain_phrases(rows, 6, 50)
    assert sorted(tuple(r) for r in got) == want and len(want) > 60


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table_of(spark, [])).count() == 0
    assert phrases.collocations(table_of(spark, [(1, None, None, None, None), (2, " \t.,", "en", "s", 1)])).count() == 0


def test_sieve_holds_all_it_was_given(spark):
    names = [("en", f"w{i} x{i % 7}") for i in range(5000)]
    packed = phrases.sieve_of(spark.createDataFrame(names, "lang string, phrase string"))
    folded = np.array([phrases.fold([np.array([phrases.word_hash(a, w.encode())], np.uint64) for w in p.split()])[0] for a, p in names], np.uint64)
    sieve = phrases.Sieve(packed)
    assert sieve.passes(folded).all()
    assert sieve.passes(folded ^ np.uint64(0x123456789)).mean() < 0.2


# --- conversation repair --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, audit string, fault string, nth int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(turns):
    """All edit sequences of a small conversation, cheapest first, least audit first."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, rows, counts = set(), [], Counter()
    for _, role, text in turns:
        words = re.search("[^ \t-\r]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None
        if not fault and not re.search(r"[.!?][ \t-\r]*\Z", text):
            fault = "truncated"
        seen.add((role, text))
        counts[fault] += 1
        rows.append((role, text, fault))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    own = sorted({t for t, *_ in turns if t is not None})
    gaps = own[-1] - own[0] + 1 - len(own) if own else 0
    grammar = re.compile(r"(s?(ua)+)?")
    frontier, best = [(0, "", 0, "", ())], None
    done = {}
    while frontier:
        frontier.sort(key=lambda x: (x[0], x[1]))
        cost, audit, at, letters, out = frontier.pop(0)
        if best and cost > best[0]:
            break
        if at == len(rows) and grammar.fullmatch(letters):
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, out
            continue
        state = (at, letters[-1:], not letters, audit.count("I"))
        if done.setdefault(state, (cost, audit)) < (cost, audit):
            continue
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[letters[-1:]]
        if audit.count("I") < 4:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if initial in follow:
                    frontier.append((cost + 5, audit + "I", at, letters + initial, (*out, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            frontier.append((cost + 2, audit + "D", at + 1, letters, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if role[:1] and role[:1] in follow:
                    frontier.append((cost + extra, audit + "K", at + 1, letters + role[0], (*out, f"{role}:{text}")))
                for initial, new in (("u", "user"), ("a", "assistant")):
                    if initial in follow:
                        frontier.append((cost + 1 + extra, audit + "R", at + 1, letters + initial, (*out, f"{new}:{text}")))
    cost, audit, out = best
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversation_rows():
    rnd = random.Random(14)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "a", "user", "assistant"])
            text = rnd.choice(["Yes.", "no", "Well?  ", "", None, " \n", f"Line {turn}.", "…", "é!\t", "\x0b"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 2, None]), role, text, "x", "y", 1))
    rows += [(None, i, "user" if i % 2 == 0 else "assistant", "Said.", "x", "y", 1) for i in range(4)]
    return rows + rows[:20] + [(900, 0, "user", "long " * 100_000 + ".", "x", "y", 1), (900, 1, "assistant", "Fine.", "x", "y", 1)]


def repaired(spark, rows):
    turns = repair.damage(repair.plain_turns(spark.createDataFrame(rows, TURNS)))
    plans = repair.plan_repairs(turns)
    digests = {r[0]: r[1] for r in repair.repaired_digests(plans.select("conv_id", "audit"), turns).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (*(r[n] for n in names), digests[r["conv_id"]]) for r in plans.collect()}, turns, plans


def test_repair_as_brute_force(spark):
    rows = conversation_rows()
    got, turns, plans = repaired(spark, rows)
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn, role, text))
    want = {conv: plain_repair(own) for conv, own in by.items()}
    assert got == want
    own = defaultdict(list)
    for r in repair.repaired_turns(plans.select("conv_id", "audit"), turns).collect():
        own[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for conv, told in want.items():
        text = "\n".join(f"{role}:{text}" for _, role, text in sorted(own[conv]))
        assert hashlib.sha256(text.encode()).hexdigest() == told[-1]


def test_repair_of_nothing(spark):
    got, *_ = repaired(spark, [])
    assert got == {}
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got, *_ = repaired(spark, [(gone, 0, "user", "Gone.", "x", "y", 1)])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_words_share_the_nodes_of_their_suffix():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("suaoxUA") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    made, own = [], repair.node
    repair.node = lambda letter, rest: made.append(letter) or own(letter, rest)
    try:
        nodes = repair.SuffixNodes()
        got = {w: nodes.read(w) for w in sorted(words, key=lambda w: w[::-1])}
    finally:
        repair.node = own
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})
    assert got == {w: repair.SuffixNodes().read(w) for w in words}


# --- packing --------------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(at) if at < len(free) else capacity) - n)
    return len(free)


def sequences_hold(pieces, capacity):
    """Gapless sequences within capacity; how many."""
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing_of_documents(spark, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_paths()[0])
    rnd = random.Random(5)
    letters = "abc deé中ß 😀'st12 \n\t٣½’ \x85\xa0　"
    rows = odd_rows() + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))), "en", "s", 1) for i in range(150)]
    rows += [(300, "<|endoftext|> a<|endoftext|>", "en", "s", 1), (301, "y" * 6000, "en", "s", 1), (302, " " * 3000 + "z", "en", "s", 1)]
    pieces = packing.pack_documents(table_of(spark, rows, wide=True).repartition(3), capacity).collect()
    count = sequences_hold(pieces, capacity)
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        start = 0
        for piece in range(-(-len(ids) // capacity)):
            end = start + ((len(ids) - start) % capacity or capacity)
            packed = np.array(ids[start:end], "<u4").tobytes()
            want[doc, piece, start, end - start, zlib.crc32(packed), packed] += 1
            start = end
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in pieces)
    assert got == want
    assert count <= best_fit_decreasing([r["length"] for r in pieces], capacity)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(table_of(spark, [])).count() == 0
    one = packing.pack_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r["length"], r["offset"]) for r in one] == [(1, 0)]


def least_bins(lengths, capacity):
    """The least number of bins by trying every place of every piece."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(at, free):
        if len(free) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(free)
            return
        for room in sorted({r for r in free if r >= lengths[at]}):
            rest = list(free)
            rest.remove(room)
            put(at + 1, [*rest, room - lengths[at]])
        put(at + 1, [*free, capacity - lengths[at]])

    put(0, [])
    return best[0]


def test_plan_against_all_packings():
    rnd = random.Random(9)
    over = 0
    for _ in range(150):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        plan = packing.best_plan(Counter(lengths), 20)
        over += plan.sequences - least_bins(lengths, 20)
        assert plan.sequences <= least_bins(lengths, 20) + 1
    assert over <= 5


@pytest.mark.parametrize("scale", [1, 37, 10**9])
def test_plan_uses_every_rank_once(scale):
    rnd = random.Random(scale)
    counts = {n: scale * rnd.randint(1, 9) for n in rnd.sample(range(1, 513), 200)}
    plan = packing.best_plan(counts, 512)
    for length, n in counts.items():
        at = 0
        for _, first, many, each, *_ in sorted(r for r in plan.rows if r[0] == length):
            assert first == at
            at += many * each
        assert at == n
    if scale < 100:
        least = best_fit_decreasing([n for n, k in counts.items() for _ in range(k)], 512)
        assert plan.sequences <= least


# --- words as arrays ------------------------------------------------------------------------------------------------


def test_words_with_one_hash_stay_apart(monkeypatch):
    """Two words that a hash takes for one stay two words."""
    monkeypatch.setattr(bpe, "_powers", lambda size: np.ones((2, size), np.uint64))
    text = "ab ba abc cab ab ba\n"
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    start, end = bpe.word_spans(chars)
    first, name = bpe.distinct(chars, start, end)
    assert [text[start[first[n]] : end[first[n]]] for n in name] == text.split()


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    model = bpe.WordBpe(bpe.vocabulary_path())
    text = " ".join(r[1] or "" for r in odd_rows()[:3]) + "It's the riverbank's 42 stones, isn't it?! " * 30 + "x" * 200
    monkeypatch.undo()
    whole = bpe.WordBpe(bpe.vocabulary_path()).encode_texts([text])
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    assert model.encode_texts([text]) == whole


assert CLASHING
