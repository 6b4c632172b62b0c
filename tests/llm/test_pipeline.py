"""The whole pipeline against plain Python, each stage by the plain form that its own tests use."""

import random

import public_tokenizers
from test_decontaminate import expected as plain_hits
from test_line_rules import expected as plain_rules
from test_shingle_join import plain as plain_components
from tokenizers import Tokenizer

import corpus_pipeline


def plain_left(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        b = t.encode()
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(first.get(b[k : k + size], i), i)
    out = []
    for i, t, *rest in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone |= set(range(k, k + size))
        out.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore"), *rest))
    return out


def test_run_matches_plain_python(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdéfg", k=rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(25)) for i in range(6)]
    passage, line, rows = text(30), text(12), []
    for i in range(140):
        body = text(rng.choice([5, 30, 60, 120]))
        if i % 5 == 0:
            body += " " + passage + " " + text(20)
        if i % 7 == 0:
            body += " " + items[i % 6][1] + " end"
        if i % 3 == 0:
            body += "\n" + line
        if i % 10 == 9:
            body = rows[rng.randrange(len(rows))][1] + rng.choice(["", " more"])
        if i % 17 == 0:
            body = (text(10) + "\n") * 8
        rows.append((i, body, "en", rng.choice(["a", "b"]), len(body)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    fine = {v[0] for v in plain_rules([(r[0], r[1], r[3]) for r in rows], 10, 0.05) if v[-1]}
    one = [r for r in rows if r[0] in fine]
    least = {d: c for d, _, c in plain_components(one)}
    two = [r for r in one if least[r[0]] == r[0]]
    three = plain_left(two)
    hit = {d for d, _, words, _ in plain_hits([(r[0], r[1]) for r in three], items) if words}
    four = [r for r in three if r[0] not in hit]
    assert len(rows) > len(one) > len(two) > len(four) and three != two

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == sorted(r[0] for r in four)
    for doc_id, left, lang, source, _ in four:
        r = found[doc_id]
        assert r.ids == library.encode(left, add_special_tokens=False).ids
        assert (r.lang, r.source, r.n_tokens) == (lang, source, len(r.ids))
