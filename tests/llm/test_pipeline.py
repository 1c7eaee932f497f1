"""Every stage of the pipeline against a plain Python version of its decisions, and on empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components
from tokenizers import Tokenizer

from quillon.llm import chat, mixing, secrets, toxicity
from quillon.llm.queries import vocabulary
from quillon.session import load, stage

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def redacted(text, more):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = "", 0
    for a, b in sorted(spans + more):
        if a > at or not at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def fewest(lengths, capacity):
    """Best fit by falling length."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_stages_decide_as_plain_python(spark):
    steps = dict(corpus_pipeline.STAGES)
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    before = rows_of(docs)

    docs = stage(steps["toxicity"](spark, docs, SF))
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(load(spark, SF, "documents"), labels).collect()}
    kept = rows_of(docs)
    assert sorted(kept) == sorted(x for x in before if not judged[x[0]]) and 0 < len(kept) < len(before)

    docs = stage(steps["ngram_jaccard_join"](spark, docs, SF))
    classes = brute_components([t for _, t in sorted(kept)])
    want = {sorted(kept)[k][0] for k, (_, root) in classes.items() if k == root}
    assert {k for k, _ in rows_of(docs)} == want and len(want) < len(kept)

    secret = "é key token = abcdef123456, " + "deadbeef" * 4 + " AKIA" + "Q7" * 10 + " end"
    docs = docs.unionByName(spark.createDataFrame([(900_001, secret, "en", "s", len(secret))], docs.schema))
    given = rows_of(docs)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["extra"]] for r in secrets.scan(docs).collect()}
    docs = stage(steps["secret_scan"](spark, docs, SF))
    after = dict(rows_of(docs))
    assert after == {k: redacted(t, found[k]) for k, t in given} and any(t != after[k] for k, t in given)

    rates = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(docs, labels, corpus_pipeline.TARGETS, corpus_pipeline.BUDGET, 1.0).collect()}
    docs = stage(steps["mixing"](spark, docs, SF))
    copies = Counter(rows_of(docs))
    assert set(copies) == set(after.items())
    assert all(math.floor(rates[k] + 1e-9) <= n <= math.ceil(rates[k] - 1e-9) and n >= 1 for (k, _), n in copies.items())

    packed = steps["best_fit_packing"](spark, docs, SF).collect()
    tokenizer, pieces, lengths = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), Counter(), []
    for (k, t), n in copies.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            pieces[k, p // 4096, p, len(part), zlib.crc32(part.tobytes())] += n
            lengths += [len(part)] * n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= fewest(lengths, 4096)


def test_stages_on_an_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    assert chat.rotate_perspectives(load(spark, SF, "conversations").limit(0)).count() == 0


def test_stages_keep_odd_rows(spark):
    """Null and empty texts, repeated rows and a very long text pass the filtering and redacting stages."""
    texts = [None, "", " ", "one two three four five six", "one two three four five six", "word " * 200_000]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", len(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, docs, SF)
    assert kept.count() == len(rows)
    one = steps["ngram_jaccard_join"](spark, docs, SF).select("doc_id").collect()
    assert sorted(r[0] for r in one) == [0, 1, 2, 3, 3, 5]
    assert sorted(map(repr, rows_of(steps["secret_scan"](spark, docs, SF)))) == sorted(repr((k, t)) for k, t, *_ in rows)
    assert steps["mixing"](spark, docs, SF).where(F.col("doc_id").isNotNull()).select("doc_id").distinct().count() == len(texts)
