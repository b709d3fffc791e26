"""The pipeline's stages on documents whose fate is known."""

import collections

import pytest

import corpus_pipeline
from capwindow.llm import bpe, mixing, neardup
from tests.llm.test_operators import BASE, SCHEMA, WORD, below_with_pairs, classes, documents, long_text, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the odd documents, written and read as the contract says."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    more = [(100 + i, long_text(50 + i, 90) + (" password=abcdef123" if i % 4 == 0 else ""), "en", f"s{i % 5}", None) + ("x",) * (len(SCHEMA) - 5) for i in range(40)]
    docs, out = spark.createDataFrame(rows_of() + more, SCHEMA), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        after = spark.read.parquet(f"{path}/{k}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == list(corpus_pipeline.DOCUMENT)


def test_quality(stages):
    before, after, _ = stages[0]
    want = collections.Counter()
    for r in before:
        w = WORD.findall(r.text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for d in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            want[r.doc_id, r.text] += 1
    assert collections.Counter((r.doc_id, r.text) for r in after) == want


def test_near_duplicates(stages):
    before, after, _ = stages[1]
    numbered = list(enumerate(r.text for r in before))
    groups = collections.defaultdict(list)
    for i, _, c in classes(numbered, 5, 80):
        groups[c].append(before[i])
    left = list(after)
    for members in groups.values():
        kept = [r for r in left if any((r.doc_id, r.text) == (m.doc_id, m.text) for m in members)]
        assert len(kept) == 1
        known = [m.doc_id for m in members if m.doc_id is not None]
        assert kept[0].doc_id == (min(known) if known else None)
    assert len(after) == len(groups)


def test_secrets(stages):
    before, after, _ = stages[2]
    assert collections.Counter(r.doc_id for r in before) == collections.Counter(r.doc_id for r in after)
    assert any("password=" in r.text for r in before) and not any("password=" in r.text for r in after)
    assert any("[SECRET]" in r.text and r.n_chars == len(r.text) for r in after)


def test_mixing(stages):
    before, after, _ = stages[3]
    whole = collections.Counter((r.doc_id, r.text) for r in before)
    taken = collections.Counter((r.doc_id, r.text) for r in after)
    assert set(taken) <= set(whole) and all(taken[k] <= 2 * whole[k] for k in taken)
    size = lambda r: len(WORD.findall(r.text or ""))
    sums = collections.Counter()
    for r in before:
        sums[r.source] += size(r)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    level = sums.total() * 1.5  # the common level of targets, by bisection
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, level + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sums[s], weight[s] * mid) for s in names) < level else (lo, mid)
    largest = max(map(size, before))
    for s in names:  # whole documents, so the target is met but for one
        assert abs(sum(size(r) for r in after if r.source == s) - min(2 * sums[s], weight[s] * lo)) <= largest


def test_tokens(stages):
    """Each row's tokens are those of the tokenizer library, and places follow the order in which the mixing stage wrote its rows."""
    import hashlib

    import public_tokenizers
    import tiktoken

    before, after, _ = stages[4]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for place, r in enumerate(before, 1):
        ids = coder.encode_ordinary(r.text or "")
        want.append((place, r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((r.place, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "place"}
    assert {r.doc_id for r in got.collect()} <= {d[0] for d in documents(spark, SMALL)}


def test_near_duplicates_just_below(spark, monkeypatch):
    """A group larger than NODE, mostly just below the stage's similarity: of the few pairs that reach it, one document stays."""
    for name, value in (("NODE", 64), ("LEAF", 16), ("PIVOTS", 4), ("DEEPEST", 3)):
        monkeypatch.setattr(neardup, name, value)
    texts = below_with_pairs(5, 180, 100, 13, 2)
    want = {c for _, _, c in classes(texts, 5, 80)}
    assert len(want) == len(texts) - 6
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, SMALL).collect()} == want
