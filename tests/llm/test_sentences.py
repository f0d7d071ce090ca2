import random

import pytest

from thicket.llm import sentences as s

CASES = [
    "The even node, see Fig. 3 and Dr. Vako, ends. It cost 3.5 ms with v1.2.",
    "Files, sockets, etc. One core builds. Files, etc., and more.",
    "A pause... but on. A pause… Then more! kiri_prefix maps it. What? 9 lines.",
    'He said "the port stops." The tree "stops!" as noted. (A whole one.) Next (see this one.) as usual.',
    "„Das Blatt.“ Am 27. Juni prüft R. D. Nake z. B. Zeilen usw. Die Zeile „trennt?“ so ein.",
    "Lit « règle ! » dit M. Banazo, etc. Une clé ? Oui.",
    "¡Cuenta núm. 15 no! ¿Puente Sr. Kirin? Guarda.",
    "Медленно в 2016 г. строка т. д. и мост... Лист «над?» и под. «Шаг».",
    "Κλειδί π.χ. το μετά; Ένα αρ. 4 όριο.",
    "行表：“水光？”风高山。长“前？”的叶（小。）合，火slice.cfg表？！木……高3.5值。",
    "早も「川！」と分でだ！「古を。」風より葉が。",
    "हि डॉ. गो तो । मे “जंगु ग।” ऐसा पा v5.7 कि॥ मे",
    "الهجف ص. 51 «لمش؟» ثم تفجن. قفستت؟ عهج",
    "ทางช้า 52 เมฆ trace ใน เขาวาง\nมีกา",
]
WANT = [2, 3, 6, 4, 3, 3, 3, 3, 2, 5, 3, 3, 3, 3]


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(1)
    parts = [p for c in CASES for p in c.split(" ")]
    return s.train(CASES * 3 + [" ".join(rng.sample(CASES, 4)) for _ in range(200)] + [" ".join(rng.sample(parts, 30)) for _ in range(300)])


@pytest.mark.parametrize("text,n", list(zip(CASES, WANT)))
def test_boundaries(tagger, text, n):
    got = [text[a:b] for a, b in tagger.units(text)]
    assert len(got) == n, got
    assert "".join("".join(got).split()) == "".join(text.split())


def test_held_out_accuracy(tagger):
    rng = random.Random(9)
    good = total = 0
    for _ in range(150):
        for text, got, gold, _ in s.chains(" ".join(rng.sample(CASES, 3))):
            total += len(gold)
            good += sum(y == g for y, g in zip(tagger.tags(text, got), gold))
    assert good / total > 0.99


def test_held_out_ends_of_paragraphs_are_found(spark, small):
    """Labels that the conventions did not make: ends that the layout gives away."""
    rows = spark.read.parquet(f"{small}/documents.parquet").filter("doc_class = 'prose' and length(text) > 0").select("text").distinct().collect()
    texts = sorted(r.text for r in rows)
    model = s.train(texts[::2])
    found = total = 0
    for t in texts[1::2]:
        for text, got, _, known in s.chains(t):
            total += sum(known)
            found += sum(y for y, k in zip(model.tags(text, got), known) if k)
    assert total > 40 and found / total > 0.97


def test_the_model_sees_words_and_characters_only():
    text = "See Dr. Vako (now). He left."
    at = s.spots(text)
    seen = [s.view(text, x, False) for x in at]
    assert [x[2] for x in seen] == ["dr", "now)", "left"] and [x[6] for x in seen] == ["vako", "he", ""]
    # the conventions annotate; words they do not list look like any other to the view
    assert s.view("See Dq. Vako", s.spots("See Dq. Vako")[0], False)[3:] == s.view("See Dr. Vako", s.spots("See Dr. Vako")[0], False)[3:]
    assert all(len(f) <= 5 for f in s._features(seen[0]))  # no feature spans the whole view


def test_joints_are_labelled_by_layout():
    chains = s.chains("It runs on p.\n\n12 more follow. End")
    joint = [(text, gold, known) for text, _, gold, known in chains if any(known)]
    assert len(joint) == 1 and joint[0][1][0] and joint[0][2][0]
    # the same place in running text is no end by the conventions
    assert s.chains("It runs on p. 12 more follow. End")[0][2][0] is False


def test_viterbi_equals_enumeration():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 7)
        score, w = [rng.uniform(-2, 2) for _ in range(n)], {("t", False, True): rng.uniform(-2, 2), ("t", True, True): rng.uniform(-2, 2)}

        def worth(tags):
            return sum(x for x, t in zip(score, tags) if t) + sum(w["t", p, True] for p, q in zip(tags, tags[1:]) if q)

        best = max(([bool(m >> i & 1) for i in range(n)] for m in range(1 << n)), key=worth)
        assert abs(worth(s.viterbi(score, w)) - worth(best)) < 1e-9


def test_blocks(tagger):
    text = "﻿# A Heading. Two\nSome text\r\nwraps here. More\n\n- one\n  still one\n* two. Three\n1. four\n\n```c\nint a. B\n```\nAfter - not a list\n- either\n\n```\nnever closed. X"
    got = [" ".join(text[a:b].split()) for a, b in tagger.units(text)]
    assert got == ["A Heading. Two", "Some text wraps here.", "More", "one still one", "two.", "Three", "four", "After - not a list - either"]


def test_offsets_nulls_long_and_repeated(spark, tagger):
    long = "😀 One two. " * 60_000
    docs = [(1, None), (2, ""), (3, " \n"), (4, "😀é One. Two"), (5, long), (6, '"(' * 2000 + "a. B"), (7, "Same. Copy"), (7, "Same. Copy"), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as start_at", "2 as lang")
    got = s.sentences(df, tagger)
    rows = got.collect()
    assert [(r.start_at, r.end_at) for r in rows if r.doc_id == 4] == [(0, 7), (8, 11)]
    assert sum(r.doc_id == 5 for r in rows) == 60_000 and sum(r.doc_id == 7 for r in rows) == 4
    assert {r.doc_id for r in rows} == {4, 5, 6, 7}
    assert s.sentences(df.limit(0), s.fit(df.limit(0))).count() == 0
    assert s.fit(df, 3, 50).units("One. Two") is not None
