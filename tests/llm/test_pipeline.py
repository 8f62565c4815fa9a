"""The pipeline against the same steps done one document at a time."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefixloom.llm import decontamination, secrets, sentencepiece_codec, simhash, toxicity


def fixture(spark, folder):
    rows, labels = [], []
    for k in range(160):
        bad = k % 5 == 0
        rows.append((k, f"plain words number {k} " + ("you scum idiot " if bad else "you are kind ") + " ".join(f"t{k * 7 + j}" for j in range(30)), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    rows += [(200, rows[3][1], "en", "s", 0), (201, "before one two three four five six seven eight nine ten after", "en", "s", 0), (202, "my password=abcdefgh12 is here", "en", "s", 0), (203, None, None, None, None), (204, "", "en", "s", 0)]
    frames = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "One two three four five six. Seven eight nine ten.")], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return rows, frames


def test_run_against_single_steps(spark, tmp_path):
    rows, frames = fixture(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    score = toxicity.fit_toxicity(frames["documents"], frames["labels"]).scorer()
    left = {r[0]: r[1] for r in rows if score(r[1]) < toxicity.THRESHOLD}
    kept = {}
    for k in sorted(left):
        if not any((simhash.fingerprint(left[k]) ^ simhash.fingerprint(left[j])).bit_count() <= 4 for j in kept):
            kept[k] = left[k]
    index = decontamination.Index([(1, frames["benchmark"].first().text)])
    kept = {k: t for k, t in kept.items() if not index.hits(t)}
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Vocabulary.load())
    clean = {k: re.sub(secrets.BASE[0].pattern, lambda m: "[SECRET]" if len(m[2]) >= 8 else m[0], t or "") for k, t in kept.items()}
    assert 200 not in got and 201 not in got and 202 in got and 5 not in got and 7 in got
    assert {k: r.ids for k, r in got.items()} == {k: encoder.ids(t) for k, t in clean.items()}


def test_stages_keep_the_columns(spark, tmp_path):
    _, frames = fixture(spark, tmp_path)
    docs = frames["documents"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0


FOLDER = "/root/testdata/sf0.001"


def brute_print(text):
    """The fingerprint by the contract's words, bit by bit."""
    xxhash = pytest.importorskip("xxhash")
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_on_the_given_tables_against_other_engines(spark):
    """Each stage on what the one before kept: labels, fingerprints by hand, the SQL of the searches, and the library's encoder."""
    duckdb, library = pytest.importorskip("duckdb"), pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: {r.doc_id: r.text for r in df.collect()}

    given = plain(docs)
    docs = stages["toxicity"](spark, docs, FOLDER).cache()
    left = plain(docs)
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.doc_id in given}
    right = sum((i in left) == (not toxic) for i, toxic in marks.items())
    assert set(left) < set(given) and right >= 0.9 * len(marks)

    groups: list[set] = []
    prints = {i: brute_print(t) for i, t in left.items()}
    for i in sorted(left):
        near = [g for g in groups if any((prints[i] ^ prints[j]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [{i}.union(*near)]
    docs = stages["near_duplicates"](spark, docs, FOLDER).cache()
    assert plain(docs) == {min(g): left[min(g)] for g in groups}

    def found(sql):
        c = duckdb.connect()
        c.register("documents", docs.toPandas())
        c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]

    before = plain(docs)
    leaked = {r["doc_id"] for r in found(decontamination.ORACLE)}
    docs = stages["decontamination"](spark, docs, FOLDER).cache()
    assert leaked and plain(docs) == {i: t for i, t in before.items() if i not in leaked}

    want = plain(docs)
    for r in found(secrets.oracle()):
        text, at, out = want[r["doc_id"]], 0, ""
        for span in filter(None, r["spans"].split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        want[r["doc_id"]] = out + text[at:]
    docs = stages["secrets"](spark, docs, FOLDER).cache()
    assert plain(docs) == want

    model = library.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert {r.doc_id: r.ids for r in stages["encoding"](spark, docs, FOLDER).collect()} == {i: model.encode(t) for i, t in want.items()}


def test_encoding_with_clashing_columns(spark, tmp_path):
    _, frames = fixture(spark, tmp_path)
    docs = frames["documents"].where("doc_id > 150").selectExpr("*", "'mine' ids", "1.5D round_trip", "'k' piece", "'c' chunk")
    got = dict(corpus_pipeline.STAGES)["encoding"](spark, docs, str(tmp_path)).collect()
    assert len(got) == docs.count() and all(isinstance(r.ids, list) for r in got)


def test_no_folder_stays_after_a_failure(spark, tmp_path, monkeypatch):
    fixture(spark, tmp_path)

    def fails(spark, docs, sf_dir):
        raise RuntimeError("stopped")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails), corpus_pipeline.STAGES[1]])
    shared = corpus_pipeline.shared_dir(spark)
    before = set(os.listdir(shared))
    with pytest.raises(RuntimeError, match="stopped"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("pipeline")]
