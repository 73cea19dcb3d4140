"""Every stage of the corpus pipeline against a plain version, on what the stage before it left."""

import re

import corpus_pipeline
import public_tokenizers
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_personal_data import plain
from tests.llm.test_repeats import brute as repeated

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {"input": {r.doc_id: r for r in docs.collect()}}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if name != "packing":
            assert docs.columns == COLUMNS
            seen[name] = {r.doc_id: r for r in docs.collect()}
    start, clean, single, cut, masked = (seen[x] for x in ("input", "toxicity", "near_dedup", "repeats", "personal_data"))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(labels.get(k) != 0 for k in set(start) - set(clean)) and all(clean[k] == start[k] for k in clean)
    groups = near_groups({k: r.text for k, r in clean.items()}, 5)
    assert set(single) == {k for k, _, _, kept in groups if kept} and all(single[k] == clean[k] for k in single)
    keys = sorted(single)
    for k, (*_, left) in zip(keys, repeated([single[k].text for k in keys], 200)):
        assert cut[k].text == left.decode("utf-8", "ignore") and cut[k].n_chars == len(cut[k].text)
    marks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    for k in keys:
        if not re.search(r"(?i) at |\d[ .)-]\d", cut[k].text):
            text, at, out = cut[k].text, 0, []
            for a, kind, b in plain(text):
                if a >= at:
                    out += [text[at:a], marks[kind]]
                at = max(at, b)
            assert masked[k].text == "".join(out) + text[at:]
        assert not plain(masked[k].text)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(masked)
    total = {k: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in masked.items()}
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in total} == total


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and len({r.sequence_id for r in rows}) == len(rows)
