"""The pipeline against a plain Python version of its stages, and edge rows."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lotwise.llm import toxicity
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near_groups

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def exact(rows):
    best = {}
    for r in rows:
        k = lower(r["text"])
        if k not in best or (r["doc_id"] is not None and (best[k]["doc_id"] is None or r["doc_id"] > best[k]["doc_id"])):
            best[k] = r
    return list(best.values())


def near(rows):
    own = {(i, c) for i, _, c in near_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    return [r for r in rows if r["doc_id"] is None or (r["doc_id"], r["doc_id"]) in own]


def mixed(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r)
    want, begin, out = targets(sizes), {}, []
    code = lambda r: hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (code(r), r["doc_id"] is not None, r["doc_id"] or 0, size(r))):
        s, n = r["source"], size(r)
        target = int(want[s] + 1e-9)
        passes = target // sizes[s] if sizes[s] else 0
        cut = max(0, min(n, target - passes * sizes[s] - begin.get(s, 0)))
        begin[s] = begin.get(s, 0) + n
        out += [r] * (int((passes * n + cut) / n + 0.5) if n else 1)
    return out


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    rows = [r.asDict() for r in docs.collect()]
    rows = mixed(near(exact([r for r in rows if score([r["text"] or ""])[0] < 0.7])))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got.collect()) == sorted(want)


def test_stages_on_edge_rows(spark):
    rows = [(1, None, None, "s", None, "k"), (2, "", "en", None, 0, "k"), (2, "", "en", None, 0, "k"), (None, "a b c", None, "s", 1, None),
            (None, "d e f", None, "s", 1, None), (3, "same words here again and again", "en", "t", 2, ""),
            (3, "same words here again and again", "en", "t", 2, ""), (4, "SAME words here again and again", "en", "t", 2, ""),
            (5, "other " * 50_000, "en", "t", 2, ""), (5, "second text of five", "en", "t", 2, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"
    docs = spark.createDataFrame(rows, schema)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        counts.append((name, out.count()))
    got = dict(counts)
    assert got["toxicity"] == 10 and got["exact_dedup"] == 6 and got["bpe"] == 10
    texts = [r.text for r in corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()]
    assert len({lower(t) for t in texts}) == 6
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == {None, 1, 2, 3, 5} and len(kept) == 9


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 5 + [(None, "e f g h", "en", "s", 7)] * 4 + [(9, "i j k l " * 9, "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plain = [dict(zip(docs.columns, r)) for r in rows]
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r["doc_id"]) for r in mixed(plain))
