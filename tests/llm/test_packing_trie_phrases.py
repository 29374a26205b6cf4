"""Best-fit packing, the prefix trie and phrase mining against brute force, with their edge cases."""

import bisect
import collections
import hashlib
import random
import zlib

import pytest

from pondflow.llm import language, packing, phrases, prefix_trie

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- packing -----------------------------------------------------------------

def brute_bins(lengths, capacity):
    """Remaining room of every bin after best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def test_plan_equals_best_fit_decreasing_piece_by_piece():
    draw = random.Random(1)
    for _ in range(200):
        capacity, hot = draw.choice([(5, 2), (16, 7), (50, 49), (100, 33)])
        lengths = [hot if draw.random() < 0.3 else draw.randint(1, capacity) for _ in range(draw.randint(0, 300))]
        histogram = collections.Counter(lengths)
        runs, used = packing.plan_runs(histogram, capacity), collections.defaultdict(list)
        for i, (n, rank, first, each, offset) in enumerate(runs):
            stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else histogram[n]
            for j in range(stop - rank):
                used[first + j // each].append((offset + j % each * n, n))
        rooms = []
        for pieces in used.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            rooms.append(capacity - at)
        assert sorted(rooms) == brute_bins(lengths, capacity)


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    texts = ["", "a  b\n\n c", "<|endoftext|> hi <|endoftext|>", "été 日本語 😀 don't I'LL", " " * 5000, "x" * 20000, "　 12ab--"]
    encoder = packing.Encoder(BPE)
    assert encoder.fast is not None
    assert encoder.ids(texts) == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    words = public_tokenizers.path("word_bpe_49k.json")  # normalised, so the library itself encodes
    assert packing.Encoder(words).ids(["Hello  World"]) == [Tokenizer.from_file(words).encode("Hello  World", add_special_tokens=False).ids]


def test_packing_places_every_token_of_every_row(spark):
    texts = [None, "", "same words here", "same words here", "long " * 700, "a b", "mid " * 50]
    rows = [(i if i != 5 else None, t, "x", 0) for i, t in enumerate(texts)] + [(2, "another text of id two", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int").repartition(3)
    placed = packing.best_fit(packing.token_pieces(df, BPE, capacity=64), capacity=64)
    got = placed.collect()
    encoder = packing.Encoder(BPE)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*encoder.ids([t or ""])[0], 0]
        head = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) == len(brute_bins([r["length"] for r in got], 64))
    whole = packing.packed_sequences(placed).collect()
    assert sum(len(s["ids"]) for s in whole) == 4 * sum(r["length"] for r in got) and len(whole) == len(bins)


def test_packing_of_an_empty_table_and_of_impossible_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit(packing.token_pieces(empty, BPE)).collect() == []
    for bad in (0, 9, None):
        with pytest.raises(Exception, match="has no place"):
            packing.best_fit(spark.createDataFrame([(bad,)], "length long"), capacity=8).collect()


# --- prefix trie ---------------------------------------------------------------

def brute_nodes(conversations):
    """(conv_id, depth) -> (parent, members, children, leaves, saved, ends digest) of {id: [(role, text), …]}."""
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for key, ids in members.items():
        below = [k for k in members if k[:len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out[(min(ids), len(key))] = (parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(spark, conversations):
    rows = [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    turns = prefix_trie.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    got = prefix_trie.prefix_trie(turns, ids).collect()
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    talks = {}
    for c in range(60):
        base = talks[draw.choice(list(talks))][:draw.randint(0, 9)] if talks and draw.random() < 0.8 else []
        talks[c * 7 + 3] = base + [(draw.choice("ua"), draw.choice(["x", "yy", "", "zzz"])) for _ in range(draw.randint(0, 4))]
    assert trie(spark, talks) == brute_nodes(talks)


def test_trie_of_long_conversations_that_part_far_down(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    line = [("u", f"t{i}") for i in range(40)]
    talks = {1: line, 2: line[:33] + [("a", "else")], 3: line[:33], 4: line[:8] + [("a", "x")] * 3, 5: line, 6: [], 7: line[:8] + [("a", "x")]}
    assert trie(spark, talks) == brute_nodes(talks)


def test_trie_of_a_large_family_takes_few_steps(spark, monkeypatch):
    written, materialise = [], prefix_trie.materialise
    monkeypatch.setattr(prefix_trie, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    draw = random.Random(3)
    talks = {c: [("s", "same")] + [(draw.choice("ua"), draw.choice("xyz")) for _ in range(draw.randint(0, 7))] for c in range(0, 900, 3)}
    talks |= {c: [("s", "same")] + [("u", "copy")] * 7 for c in range(1, 300, 3)}
    assert trie(spark, talks) == brute_nodes(talks)
    assert len(written) <= 16, written  # grows with the bits of the longest conversation, not with the family


def test_turns_are_numbered_with_nulls_ties_and_repeats(spark):
    rows = [(1, None, "u", "b"), (1, 2, None, None), (1, 1, "u", "same"), (1, 1, "u", "same"), (1, 1, "a", "same"), (None, 1, "u", "lost"), (2, 1, "u", "é")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, digest string")
    got = prefix_trie.number_turns(df).orderBy("conv_id", "n").collect()
    assert [(r["conv_id"], r["n"], r["chars"]) for r in got] == [(1, 1, 1), (1, 2, 4), (1, 3, 4), (1, 4, 4), (1, 5, 0), (2, 1, 1)]
    assert got[2]["digest"] == got[3]["digest"] != got[1]["digest"]
    none = prefix_trie.number_turns(df.limit(0))
    assert prefix_trie.prefix_trie(none, none).count() == 0


def test_shared_heads_are_rebuilt(spark):
    def h(c):
        return zlib.crc32(str(c).encode()) % 6
    turns = {c: [("u", f"{c}-{i}") for i in range(n)] for c, n in ((100, 3), (101, 6), (117, 1), (205, 6), (250, 2))}
    rows = [(c, i, *t) for c, ts in turns.items() for i, t in enumerate(ts)]
    numbered = prefix_trie.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    digest = {t: hashlib.sha256(f"1:{t[0]}{t[1]}".encode()).digest()[:16] for ts in turns.values() for t in ts}
    got = collections.defaultdict(dict)
    for r in prefix_trie.with_shared_heads(numbered).collect():
        got[r["conv_id"]][r["n"]] = bytes(r["digest"])
    for c, ts in turns.items():
        want = turns.get(c - c % 100, [])[:h(c)] + ts[h(c):]
        assert [got[c][n] for n in sorted(got[c])] == [digest[t] for t in want] and sorted(got[c]) == list(range(1, len(want) + 1))


# --- phrases -------------------------------------------------------------------

def brute_phrases(docs, least, top, longest=4, cover=80):
    import re

    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        longer = [b for (x, v), b in f.items() if x == lang and b >= least and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= cover * a for b in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("slice_bytes", [1 << 21, 97])
def test_phrases_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)  # seen by local tasks only through the functions' module
    draw = random.Random(5)
    words = ["The", "of", "été", "x\x0by", "aa", "b", "New", "York", "city", "日本"]
    docs = [(draw.choice(["en", "fr", None]), "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(draw.randint(0, 60))))
            for _ in range(60)]
    docs += [("en", None), ("en", ""), ("fr", " .,;"), ("en", "New York city " * 30), ("en", "a b c d e " * 400)]
    df = spark.createDataFrame([(lang, t, 1, "z") for lang, t in docs], "lang string, text string, rank int, phrase string")
    got = {tuple(r) for r in phrases.collocations(df, least=4, top=25).collect()}
    assert got == brute_phrases(docs, 4, 25)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


# --- language labels -------------------------------------------------------------

def test_language_learns_each_row_with_its_own_label_where_ids_repeat(spark):
    draw = random.Random(3)

    def text(letters):
        return " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(i, text("abcde"), "aa") for i in range(300)] + [(i, text("vwxyz"), "bb") for i in range(300)] + [(None, text("abcde"), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(df, lambda i: i % 5 != 0).join(df.select("doc_id", "lang").distinct(), "doc_id")
    assert {r["lang_pred"] for r in language.identify(df.where("lang = 'aa'"), lambda i: i % 5 != 0).collect()} == {"aa"}
    right = language.identify(df, lambda i: i % 5 != 0).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in right} == {"aa": 301, "bb": 300} and found.count() > 0
