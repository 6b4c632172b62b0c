"""Rotated dialogues against plain Python, on small and awkward tables."""

import re

from notewright.llm import chat
from notewright.llm.chat import rotated_dialogues

SCHEMA = "conv_id long, turn long, role string, text string, name string, perspective int"


def plain(rows):
    escape = lambda t: (t or "").replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")
    escape_name = lambda t: escape(t).replace("\n", "\\n").replace("\r", "\\r")
    turns = [(c, t, r if r is not None else "unknown", escape(x)) for c, t, r, x, *_ in rows]
    out = []
    for conv, turn, speaker, said in turns:
        for own in {s for c, _, s, _ in turns if c == conv and s != "system"}:
            role = "system" if speaker == "system" else "assistant" if speaker == own else "user"
            name = escape_name(speaker) if role == "user" else None
            head = f"<|{role}{' ' + name if name is not None else ''}|>\n"
            trained = speaker == own
            mask = (len(head), len(head + said + "<|end|>")) if trained else (0, 0)
            out.append((conv, own, turn, role, name, head + said + "<|end|>\n", *mask, trained))
    return sorted(out, key=repr)


def test_matches_plain_python(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 50)
    rows = [(1, t, r, x, "n", 3) for t, (r, x) in enumerate([("system", "Be kind"), ("ana", "hi <|end|>"), ("bo", ""), ("ana", None), (None, "é" * 9)])]
    rows += [(2, 0, "system", "alone", "n", 1), (3, 0, "<|x", "same", "n", 1), (3, 0, "<|x", "same", "n", 1), (3, 0, "y", "tie", "n", 1)]
    rows += [(None, 0, "p", "no id", "n", 1), (None, 1, "q", "z" * 100000, "n", 1), (4, None, "p", "no turn", "n", 1)]
    rows += [(9, k, f"s{k % 3}", str(k), "n", 1) for k in range(400)]
    rows += [(5, 0, "assistant|>\nx", "a <\\| b <| c |> \\", "n", 1), (5, 1, "b\r\\", "<|>", "n", 1), (5, -3, "b", "\\n", "n", 1)]
    df = rotated_dialogues(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, df.collect()), key=repr) == plain(rows)
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


def test_no_name_or_text_ends_or_opens_a_mark(spark):
    names = ["assistant|>\nx", "a", "a\\", "<|user a|>", "a\n", "a\\n", "\r"]
    rows = [(1, k, n, n, "", 0) for k, n in enumerate(names)]
    found = rotated_dialogues(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in found:
        head, said = r.rendered.split("|>\n", 1)
        assert head.startswith("<|") and "<|" not in head[2:] and "|>" not in head and "\n" not in head
        assert said.endswith("<|end|>\n") and "<|" not in said[:-8] and "|>" not in said[:-8]
    assert len({(r.turn, r.name) for r in found if r.name is not None}) == len({r.name for r in found if r.name is not None}) == len(names)


def test_empty_table(spark):
    assert rotated_dialogues(spark.createDataFrame([], SCHEMA)).collect() == []
