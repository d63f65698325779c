"""run() against the same five stages in plain Python."""

import corpus_pipeline
from tessera.llm import decontaminate, langid, secrets

from . import plain
from .test_packing import encoded


def test_stages_and_result(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.fit(docs)
    told = [(d, t) for d, t in rows if t and langid.has_letter(t) and model.predict([t.encode()])[1][0] >= 0.3]
    groups = plain.joined(told)
    single = [(d, t) for d, t in told if groups[d][1] == d]
    clean = []
    for d, t in single:
        _, n, hit, _, _, _ = plain.decontaminated([(d, t)], items)[0]
        if hit >= 0.5 * n and hit:
            continue
        if hit:
            spans = decontaminate.SuffixAutomaton([(str(i), decontaminate.normal_words(x.encode())) for i, x in items]).scan(decontaminate.normal_words(t.encode()))[0]
            t = decontaminate.cut_spans(t, [x for s in spans for x in s])
        clean.append((d, t))
    scanner = secrets.fit(spark.createDataFrame(clean, "doc_id long, text string"))
    want = []
    for d, t in clean:
        out, at = "", 0
        for _, a, b, _ in scanner.spans(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        ids = encoded(out + t[at:])
        want += [(d, k, s, len(ids[s : s + 4096]), plain.crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert len(single) < len(told)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names, name
