"""The pipeline against its stages done by hand, and life without the subpackage."""

import subprocess
import sys

import corpus_pipeline as P
from quire.llm import decontaminate, quality_rules, simhash_dedup, suffix_dedup


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]


def test_run_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 250")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {r["doc_id"]: r["text"] for r in quality_rules.judge(docs).where("kept").collect()}
    fp = {i: simhash_dedup.simhash(t) for i, t in good.items()}
    root = {i: i for i in fp}
    for _ in range(len(fp)):
        new = {i: min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4) for i in fp}
        if new == root:
            break
        root = new
    kept = {i: good[i] for i in fp if root[i] == i}
    low, cut = {}, {}
    for i in sorted(kept):
        t = kept[i].encode()
        gone = set()
        for k in range(len(t) - 49):
            if low.setdefault(t[k:k + 50], i) < i:
                gone.update(range(k, k + 50))
        cut[i] = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore") if gone else kept[i]
    index = decontaminate.ItemIndex([tuple(r) for r in items.collect()])
    left = {i: t for i, t in cut.items() if t.strip() and not index.matches(t, decontaminate._WordHashes())}
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())


def test_middle_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_entry_without_the_subpackage():
    code = ("import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as E; q = E.queries(); assert 'pipeline' not in q and len(q) > 100; E.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=P.__file__.rsplit("/", 1)[0])


def test_nothing_else_imports_the_subpackage():
    import pathlib
    top = pathlib.Path(P.__file__).parent
    for f in [*top.glob("quire/**/*.py")]:
        if "llm" not in f.parts:
            assert "quire.llm" not in f.read_text()
