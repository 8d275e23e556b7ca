"""Each stage of the pipeline on the rows that the one before kept, against brute force."""

import re

import corpus_pipeline
import zstandard
from conftest import DATA
from test_operators import closure, matching_lines, shingles

from strandlake.llm import quality, tokens

FOLDER = f"{DATA}/sf0.001"


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0]) if name != "packing" else before_packing
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
        texts = [r[1] for r in before]
        if name == "quality_rules":
            packer = zstandard.ZstdCompressor(level=quality.LEVEL)
            want = [r for r in before if quality.measure(None if r[1] is None else r[1].encode(), packer)[6]]
        elif name == "line_dedup":
            gone = [set(x[2]) for x in matching_lines(texts)]
            want = [(r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in g), *r[2:]) for r, g in zip(before, gone, strict=True)]
        elif name == "ngram_join":
            sets = [shingles(t) for t in texts]
            links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            want = [before[k] for k in sorted(set(closure(len(sets), links)))]
        elif name == "decontamination":
            windows = set()
            for (item,) in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect():
                w = normal(item)
                windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            widths = {len(x) for x in windows}
            want = [r for r in before if not any(tuple(w[k : k + n]) in windows for w in [normal(r[1])] for n in widths for k in range(len(w) - n + 1))]
            before_packing = want
        else:
            tok = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"))
            found = {}
            for r in docs.collect():
                found[r.doc_id] = found.get(r.doc_id, 0) + r.length
            assert found == {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in before}
            continue
        assert kept[name] == want, name
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
