"""Source divergence and token counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polybag.llm import op11_divergence, op12_token_counts
from polybag.llm.catalog import QUERIES
from polybag.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_divergence(rows, min_docs=3, top=200):
    """Every group against every other over the whole vocabulary, in Python's integers."""
    by_lang = defaultdict(list)
    for text, lang, source in rows:
        by_lang[lang or ""].append((source or "", terms(text)))
    out = set()
    for lang, docs in by_lang.items():
        df = Counter(t for _, ts in docs for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        sums = defaultdict(Counter)
        for source, ts in docs:
            sums[source].update(ts)
        p = {s: shares(c) for s, c in sums.items()}
        q = shares(sum(sums.values(), Counter()))
        for s in sums:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sums if o != s]
            marked = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sums[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", marked, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])}
    return out


def corpus(n=120):
    random.seed(5)
    words = [f"{a}{b}" for a in ("Ab", "ça", "漢字", "x") for b in ("c", "É", "dd", "z")]
    rows = []
    for i in range(n):
        lang, source = random.choice(["en", None, "", "fr"]), random.choice(["a", "b", None, "c", "é"])
        n_words = random.choice([0, 1, 5, 40])
        rows.append((" ".join(random.choices(words, k=n_words)) if i % 11 else None, lang, source))
    # A group without terms, a language of rare terms, one term everywhere, repeated rows.
    return rows + [("12 3!", "en", "empty"), ("rare terms", "de", "a"), ("seldom", "de", "b"),
                   (None, "de", "c"), *[("the " * 300 + "Ab", "en", "a")] * 4, ("\0the\0 ", "e\0n", "a")]


def of_rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOCS)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("vocabulary", [op11_divergence.VOCABULARY, 0])
def test_divergence_is_that_of_the_whole_vocabulary(spark, vocabulary):
    rows = corpus()
    got = plain(op11_divergence.divergence(of_rows(spark, rows), top=3, vocabulary=vocabulary))
    assert set(got) == brute_divergence(rows, top=3) and max(got.values()) == 1


def test_divergence_of_the_test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    got = QUERIES["op11_divergence"](spark, sf_dir)
    assert set(plain(got)) == brute_divergence(rows)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string",
                                "item": "string", "value": "bigint", "rank": "int"}


def test_divergence_of_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("text", "lang", "source").collect()]
    assert set(plain(op11_divergence.divergence_digest(awkward))) == brute_divergence(rows)
    assert op11_divergence.divergence_digest(nothing).count() == 0


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(op12_token_counts.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)

    def count(texts):
        return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return count


@pytest.fixture(scope="module")
def compiled():
    file, kinds = op12_token_counts.compiled(op12_token_counts.default_path())
    return file, np.frombuffer(kinds, dtype=np.uint8)


PARTS = ["a", "s", "t", "re", "ve", "ll", "d", "'", "' ", "  ", "\n", "\t", " ", "1", "٣", "é", "漢", "字", "🎉", "!", "?",
         "<|endoftext|>", "<|endof", " ", "　", "\x00", "\x85", "ing", "the", "The", "́", "ſ", "'S", "'re",
         "​", "xxxxxxx", "\r\n", "𝒳", "²", "Ⅷ", "\U000e0041", "￿", "-" * 9]


def mixtures(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]
    points = [(1, 0x2FF), (1, 0xD7FF), (0xE000, 0x10FFFF)]
    return texts + ["".join(chr(rng.randint(*rng.choice(points))) for _ in range(rng.randint(0, 50)))
                    for _ in range(n // 4)]


def test_counts_are_the_librarys(compiled, library):
    texts = mixtures(4_000, 1)
    assert op12_token_counts.TokenCounter(*compiled).counts(texts).tolist() == library(texts)


def test_counts_do_not_depend_on_blocks_or_states(compiled, library):
    small = op12_token_counts.TokenCounter(*compiled, block=50)
    small.merges.states = 100
    texts = [" ".join(mixtures(12, i)) for i in range(60)] + ["x" * 3_000, " " * 3_000, "'" * 500 + "re"]
    assert small.counts(texts).tolist() == library(texts)


def test_transducer_against_the_merges(compiled):
    merges = op12_token_counts.TokenCounter(*compiled).merges
    rng = random.Random(3)
    for _ in range(2_000):
        piece = bytes(rng.choices(b"aehinorst\xc3\xa9 \xff", k=rng.randint(1, 14)))
        assert merges.count(piece) == len(merges.merged(piece))
    tokens = {token: piece for piece, token in merges.ids.items() if len(piece) < 12}
    whole = [t for t in rng.sample(sorted(tokens), 3_000) if merges.merged(tokens[t]) == [t]]
    for a, b in zip(whole, whole[1:] + whole[:1]):
        assert merges.fits(a, b) == (merges.merged(tokens[a] + tokens[b]) == [a, b])


def test_scan_composes_the_maps():
    cutter, rng = op12_token_counts.WordCutter(), np.random.default_rng(0)
    kinds = rng.integers(0, 12, 256 * 13, dtype=np.uint8)
    states = cutter.scan(cutter.maps(np.ascontiguousarray(kinds.reshape(13, 256).T)))
    for start in range(12):
        state = start
        for i, kind in enumerate(kinds):
            state = op12_token_counts.cut_step(state, int(kind))[0]
            if i % 256 == 255:
                assert states[i // 256, start] == state * 12


def test_token_digest(spark, sf_dir, library, awkward, nothing):
    for docs in (table(spark, sf_dir, "documents"), awkward):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = Counter((i, len(text.encode()), n, n > 1024)
                       for (i, text), n in zip(rows, library([text for _, text in rows])))
        assert plain(op12_token_counts.token_digest(docs)) == want
    assert op12_token_counts.token_digest(nothing).count() == 0
    whole = op12_token_counts.with_token_counts(awkward, name="size")
    assert whole.columns == awkward.columns and whole.count() == 11


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        op12_token_counts.compiled(public_tokenizers.path("word_bpe_49k.json"))
