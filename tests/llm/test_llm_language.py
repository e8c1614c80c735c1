"""n-gram scores, alignments of tokenizers and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basinflow.llm import alignment, backoff, spelling
from basinflow.llm.queries import split_pattern, tokenizer_file

SCHEMA = "doc_id long, text string, _row long, part string, block int, word int, pair string"
WORDS = "The the ring Ring thing rinng in on of ronge, été Été pages\x1cb x".split(" ")


def rows_of(seed: int, n: int = 80):
    """Hostile rows: null and repeated identifiers, null and empty texts, one very long text, copies."""
    rng = np.random.default_rng(seed)
    rows = [(None, "the ring of"), (None, None), (3, ""), (3, " \t\r\n"), (3, "the ring of"), (7, "the ring of"), (-5, "   The  ring"), (11, "ring " * 4000 + "end"), (12, "x" * 5000)]
    rows += [(int(i), " ".join(rng.choice(WORDS, int(rng.integers(1, 40))))) for i in range(20, 20 + n)]
    return [(i, t, 1, "p", 2, 3, "q") for i, t in rows]


def plain_scores(rows, order, prior):
    """Scores by counts of tuples of words, without an automaton."""
    split = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter()
    for words, out in zip(split, held):
        for at in range(len(words) + 1) if not out else ():
            for k in range(1, order + 1):
                if at - k + 1 >= 0:
                    count[tuple(["<begin>", *words][at - k + 1 : at + 1])] += 1
    learned = [c for g, c in count.items() if len(g) == 1 and g != ("<begin>",)]
    n, v = sum(learned), len(learned)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 0.5) / (n + 0.5 * (v + 1))
        return (count[gram] + prior * p(gram[1:])) / (count[gram[:-1]] + prior)

    out = []
    for (i, _), words, h in zip(rows, split, held):
        whole = ["<begin>", *words]
        score = sum(math.log10(p(tuple(whole[max(0, at - order + 1) : at + 1]))) for at in range(1, len(whole)))
        out.append((i, h, len(words), sum(count[(w,)] > 0 for w in words), n, sum(math.log10(p((w,))) for w in words), score))
    return out


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, round(x, 5) if isinstance(x, float) else x) for x in r))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores_equal_plain_ones(spark, order):
    rows = rows_of(order)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = [tuple(r) for r in backoff.score(docs, order, 3.0, block_bytes=600, part_keys=200).collect()]
    want = by_key(plain_scores([r[:2] for r in rows], order, 3.0))
    for a, b in zip(by_key(found), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_backoff_without_texts_to_learn_from(spark):
    assert backoff.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if backoff.is_held_out(i))
    rows = backoff.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(held, True, 3, 0, 0, 0.0, pytest.approx(0.0))]


def test_contexts_leave_no_mass_over(spark):
    """After any context, the probabilities of all learned words and of one more add up to 1."""
    rows = [(i, t) for i, t in [(0, "a b a c a b"), (2, "b a a"), (3, "c")] if not backoff.is_held_out(i)]
    vocabulary = ["a", "b", "c"]
    tests = [next(i for i in range(k, 10**6, 1000) if backoff.is_held_out(i)) for k in range(4)]
    asked = [(tests[k], f"a {w}") for k, w in enumerate([*vocabulary, "unseen"])]
    short = [(next(i for i in range(999, 10**6, 1000) if backoff.is_held_out(i)), "a")]
    found = {r["doc_id"]: r for r in backoff.score(spark.createDataFrame(rows + asked + short, "doc_id long, text string"), prior=2.0).collect()}
    plain = {i: s for i, _, _, _, _, _, s in plain_scores(rows + asked + short, 2, 2.0)}
    assert all(found[i]["score"] == pytest.approx(plain[i]) for i in plain)


def test_model_beats_single_words_on_held_out_texts(spark):
    found = backoff.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    row = found.where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row["s"] > row["b"]


def library_groups(text):
    """Both libraries' tokens of a text and their byte ranges, None where they do not spell it."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    if not hasattr(library_groups, "models"):
        path = tokenizer_file("byte_bpe_50k.json")
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        with open(path) as f:
            names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
        library_groups.models = model, names, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    model, names, pieces = library_groups.models
    byte = alignment.byte_of_char()
    whole, sides = (" " + text).encode(), []
    a = model.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    for ids, spell in ((a, lambda i: bytes(byte[c] for c in names[i])), (b, lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", pieces.id_to_piece(i)) else pieces.id_to_piece(i).replace("▁", " ").encode())):
        parts = [spell(i) for i in ids]
        if b"".join(parts) != whole:
            return None
        ends = np.cumsum([len(x) for x in parts]).tolist()
        sides.append((ids, ends))
    return sides


def plain_alignment(rows):
    aligned, corpus = [], Counter()
    for i, text in rows:
        sides = library_groups(text)
        if sides is None:
            aligned.append((i, 0, 0, 0, [], ""))
            continue
        (a, a_ends), (b, b_ends) = sides
        links = [(x, y) for x, e, s in zip(a, a_ends, [0, *a_ends]) for y, f, t in zip(b, b_ends, [0, *b_ends]) if max(s, t) < min(e, f)]
        corpus.update(links)
        cuts = sorted(set(a_ends) & set(b_ends))
        text = ";".join(",".join(str(x) for x, e in zip(a, a_ends) if low < e <= high) + "|" + ",".join(str(y) for y, e in zip(b, b_ends) if low < e <= high) for low, high in zip([0, *cuts], cuts))
        aligned.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), c in corpus.items():
        top[y] = max(top[y], c)
    return [(i, na, nb, g, len(ls), sum(corpus[x] == top[x[1]] for x in ls), sum(corpus[x] for x in ls), h) for i, na, nb, g, ls, h in aligned]


TEXTS = [None, "", " ", "  ", "a  b ", "\n", "<|endoftext|> and <s> or <0x41>", "▁ is lost", "a b", "中文字 和 ☃ \U0001f600", "\0", "it's 1234 o'clock\r\n\t", "the " * 3000, "antidisestablishmentarianism" * 40, "étÉ naïve  co-op", " lead", "trail   "]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 20, 0])
def test_alignment_equals_all_pairs_of_ranges(spark, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice([" ", "the", "ing", "é", "\n", "12", "!", "Aa", "  "], int(rng.integers(1, 30)))) for _ in range(60)]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(4, "a  b "), (4, "the the")]
    docs = spark.createDataFrame([(i, t, 1, "p", 2, 3, "q") for i, t in rows], SCHEMA).repartition(4)
    paths = (tokenizer_file("byte_bpe_50k.json"), split_pattern(), tokenizer_file("piece_bpe_32k.model"))
    found = [tuple(r) for r in alignment.scored(alignment.counted(alignment.align(docs, *paths))).collect()]
    assert by_key(found) == by_key(plain_alignment(rows))
    assert by_key(tuple(r) for r in alignment.scored(alignment.align_counted(docs, *paths)).collect()) == by_key(found)
    assert alignment.scored(alignment.counted(alignment.align(docs.limit(0), *paths))).count() == 0


def test_alignment_of_each_part_once(monkeypatch):
    """Texts of the same parts cost no more than one of them, and no cut of a text changes its rows: each list
    of ends that gallops holds new parts only, whatever is kept and laid end to end."""
    model, driven, gallop = alignment.Aligner(tokenizer_file("byte_bpe_50k.json"), split_pattern(), tokenizer_file("piece_bpe_32k.model")), [], alignment.gallop
    monkeypatch.setattr(alignment, "gallop", lambda short, long: driven.append(len(short)) or gallop(short, long))
    list(model.batch(["the ring, " * 500 + "end", "end the ring,\n" * 300]))
    assert 0 < sum(driven) < 40
    rng = np.random.default_rng(8)
    white = [" ", "  ", "\n", "\n\n", "\r", ";\r", "{\r\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "\u200b", "\ufeff"]
    texts = TEXTS + ["".join(rng.choice([*white, "a", "the", "'s", "!", "é", "▁", "12", "<s>", "\0"], int(rng.integers(1, 25)))) for _ in range(1500)]
    for kept, joined in ((alignment.KEPT, alignment.JOINED), (50, 3)):
        monkeypatch.setattr(alignment, "KEPT", kept)
        monkeypatch.setattr(alignment, "JOINED", joined)
        for at in range(0, len(texts), 100):
            sides = model.batch(texts[at : at + 100])
            for k, text in enumerate(texts[at : at + 100]):
                a, b, a_sizes, b_sizes, first, last = (values[ends[k] : ends[k + 1]].tolist() for values, ends in sides)
                (a_want, a_ends), (b_want, b_ends) = (library_groups(text) if text else None) or (([], []), ([], []))
                assert (a, b) == (a_want, b_want)
                assert [a_ends[i - 1] for i in np.cumsum(a_sizes, dtype=int)] == [b_ends[i - 1] for i in np.cumsum(b_sizes, dtype=int)] == sorted({*a_ends} & {*b_ends})
                starts = zip([0, *a_ends], a_ends)
                assert list(zip(first, last)) == [(np.searchsorted(b_ends, x, "right"), np.searchsorted(b_ends, y)) for x, y in starts]


def test_gallop_counts_smaller_values():
    rng = np.random.default_rng(1)
    for _ in range(200):
        long = sorted(set(rng.integers(0, 300, int(rng.integers(1, 200))).tolist()))
        short = sorted(set(rng.integers(0, 320, int(rng.integers(0, 60))).tolist()))
        assert alignment.gallop(short, long) == np.searchsorted(long, short).tolist()


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for a, others in beside.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * words[a] else None

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return [(a, form[a], root(a), n, len(beside[a]), words.get(form[a])) for a, n in words.items()]


@pytest.mark.parametrize("parts", [1, 6])
def test_spelling_variants_equal_all_pairs(spark, parts):
    rng = np.random.default_rng(parts)
    stems = ["lettering", "letterings", "lettéring", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "shelter", "shelters", "smelter", "sheltér×", "ÉTAGÈRES", "étagère"]
    rows = [(None, "shelter SHELTER Shelters " * 30), (None, None), (1, ""), (1, "lettering lettering1lettering")]
    rows += [(5, "y" * 3000), (6, "y" * 3000), (7, "y" * 2999 + "z"), (8, "y" * 2999 + "z")]
    for i in range(300):
        words = []
        for w in rng.choice(stems, 12, p=[0.4, 0.2, *[0.04] * 10]):
            at = int(rng.integers(0, len(w)))
            words.append(w if rng.random() < 0.7 else w[:at] + str(rng.choice(["", "e", "tt"])) + w[at + 1 :])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, 1, "p", 2, 3, "q") for i, t in rows], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = [tuple(r) for r in spelling.variants(spelling.word_counts(docs)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_variants(rows)
    assert sorted(found, key=str) == sorted(want, key=str)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want) or parts


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_node_numbers_are_those_of_prefixes(spark):
    """Words spread over partitions: two words share a number if and only if they share that beginning."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(1, 9)))) for _ in range(200)})
    found = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word", "f").collect()
    number = {}
    for r in found:
        for k, x in enumerate(r["f"]):
            assert number.setdefault(r["word"][:k], x) == x
    assert len(set(number.values())) == len(number)
