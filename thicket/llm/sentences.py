"""Sentences of texts in many languages and scripts.

Method: characters are tagged boundary or inside by a linear-chain model with Viterbi decoding.
Letters and digits are inside with certainty, so the chain is decoded over the marks that can end
a sentence and the blanks of scripts written without marks (``spots``). The model sees raw
context only (``view``): the characters of the mark, the words before and after it as they are written
and by shape, the gap, the scripts on both sides, the quotation or bracket that closes there, what
stood before it was opened, and the one around. Weights of these, of small combinations of them
and of tag transitions come from an averaged structured perceptron.

Training text is annotated in two ways (``chains``). Where one paragraph or item ends in a mark and the
next begins, a sentence ends: the layout says so, and both are read as one running text with that
label. The other marks are annotated by the labelling conventions (``convention`` and ``label``: word
lists, ordinals, quotation rules), of which prediction knows nothing; what it knows of
abbreviations or quotations it has learned from the words and characters around them. Annotated are
about ``SAMPLE_DOCS`` documents of the corpus, up to ``SAMPLE_CHARS`` characters each. Text in scripts
without marks is stripped of marks before it is used for training. Prediction reads every document whole.

Blocks come first: blank lines separate blocks, fenced blocks hold no units, a heading line is
a unit without its #s, a block that starts with a list marker is cut at every marker.

Defined cases: null, empty or blank text has no units; a fence that is never closed runs to the
end; quotes and brackets without a partner are ignored; a byte order mark is trimmed like a
blank; repeated documents give equal rows once per ``doc_id`` and text; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import category

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_CHARS, EPOCHS, KNOWN = 700, 6000, 4, 300_000

#: Fixed values of the conventions: abbreviations that end nothing, in no case followed by a new sentence.
ABBREVIATIONS = frozenset(
    "Dr Prof Mr Mrs Ms St Jr Sr Sra Dra Mme Mlle vs cf e.g i.e a.m p.m approx Fig fig Sec sec Eq No Vol pp ex env ej núm pág "
    "p z d h ca Nr Abb Str bzw ggf évtl vgl т е д г см рис стр им ул δηλ π.χ αρ σελ क्र डॉ श्री ص د م".split()
)
#: Abbreviations that end a sentence if a new one follows.
LIST_ENDS = frozenset(["etc", "usw"])
#: Months after which a number with a stop is an ordinal, and words before one.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
ORDINAL_BEFORE = frozenset("am im der die das dem den zum vom beim".split())

_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "«": "»", "“": "”", "「": "」", "『": "』", "‘": "’", "„": "“"}
_CLOSE = {c for c in _OPEN.values()} | {'"', "”"}
_BRACKETS = frozenset("(（[【")
_STARTERS = "([{（【«“„「『‘\"'"
_MARK = re.compile(r"[.!?…。！？｡؟۔।॥;;]+|(?<=[฀-๿])[ \t ]+(?=\S)|(?<=\S)[ \t ]+(?=[฀-๿])")
_QUOTES = re.compile(r"[(（\[【«“「『‘„)）\]】»”」』’\"]")
_FLAT = str.maketrans("\r\n  ", "    ")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_HEADING = re.compile(r"[ \t﻿]*#{1,6}(?=[ \t])")
_MARKER = re.compile(r"[ \t﻿]*(?:[-*+]|\d{1,9}\.)[ \t]+")
_NAME = re.compile(r"[a-z][^\W_]*_\w*")
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[\u3040-\u30ff]")
_TRIM = " \t\r\n\x0b\x0c   　﻿​"


def segments(text: str) -> list[tuple[int, int, bool]]:
    """Ranges of paragraphs, items and headings; whether a range is a heading."""
    out: list[tuple[int, int, bool]] = []
    start = end = -1
    fenced = listing = False
    at, n = 0, len(text)
    while at < n:
        stop = _LINE.match(text, at).end()
        line = text[at:stop].strip(_TRIM)
        if line.startswith("```") or fenced or not line:
            if start >= 0:
                out.append((start, end, False))
            start, listing = -1, False
            if line.startswith("```"):
                fenced = not fenced
        elif h := _HEADING.match(text, at):
            if start >= 0:
                out.append((start, end, False))
            out.append((h.end(), stop, True))
            start, listing = -1, False
        else:
            m = _MARKER.match(text, at)
            if m and m.end() < stop and (start < 0 or listing):
                if start >= 0:
                    out.append((start, end, False))
                start, listing = m.end(), True
            elif start < 0:
                start = at
            end = stop
        at = stop
    if start >= 0:
        out.append((start, end, False))
    return out


def _pairs(s: str) -> list[tuple[int, int]]:
    """Matched quotes and brackets as (open, close), in order of closing."""
    stack: list[tuple[int, str]] = []
    found = []
    for m in _QUOTES.finditer(s):
        i, c = m.start(), m.group()
        if c == '"':
            if stack and any(x == '"' for _, x in stack):
                while stack[-1][1] != '"':
                    stack.pop()
                found.append((stack.pop()[0], i))
            else:
                stack.append((i, '"'))
        elif c in _CLOSE and any(x == c or (x == "“" and c == "”") for _, x in stack):
            if c == "’" and i + 1 < len(s) and s[i + 1].isalpha():
                continue
            while stack and stack[-1][1] != c:
                stack.pop()
            if stack:
                found.append((stack.pop()[0], i))
        elif c in _OPEN:
            # „ is closed by “ or by ”
            close = _OPEN[c]
            if c == "„":
                a, b = s.find("“", i), s.find("”", i)
                close = "”" if b >= 0 and (a < 0 or b < a) else "“"
            stack.append((i, close))
    return found


def _kind(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "cjk"
    return "other"


def _after(s: str, at: int) -> str:
    """The kind of word that follows."""
    n = len(s)
    while at < n and (s[at] in _STARTERS or s[at] in " \t "):
        at += 1
    if at >= n:
        return "end"
    c = s[at]
    if c in "¡¿":
        return "upper"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        k = _kind(c)
        if k in ("cjk", "thai"):
            return "to" if c == "と" else k
        if c.islower():
            return "name" if _NAME.match(s, at) else "lower"
        return "upper" if c.isupper() else "caseless"
    return "soft" if c in ",;:)]}-–—、，：；·" else "sign"


Spot = tuple[int, int, int, int, int]


def spots(s: str) -> list[Spot]:
    """Where a sentence of this flat segment could end, from raw characters alone.

    A spot is (start and end of the mark, end of the unit, place where the quotation or bracket that
    closes there was opened or -1, place where the one around it was opened or -1).
    """
    marks = list(_MARK.finditer(s))
    if not marks:
        return []
    pairs = _pairs(s) if _QUOTES.search(s) else []
    closes = {b: a for a, b in pairs}
    out: list[Spot] = []
    last = -1
    for m in marks:
        i, j = m.start(), m.end()
        if i < last:
            continue
        if s[i] in " \t\u00a0":
            if s[i - 1] not in ".!?…":
                out.append((i, j, i, -1, max((p for p, q in pairs if p < i < q), default=-1)))
            continue
        # closing quotes and brackets belong to the unit; French sets them off by a blank
        opened, end = -1, j
        while True:
            k = end
            if k < len(s) and s[k] in " \u00a0\u202f" and k + 1 < len(s) and s[k + 1] == "»" and k + 1 in closes:
                k += 1
            if k in closes and k < len(s):
                opened = closes[k]
                end = k + 1
            elif end < len(s) and s[end] in ")]）】”»」』" and end not in closes:
                end += 1
            else:
                break
        last = end
        out.append((i, j, end, opened, max((p for p, q in pairs if p < i and q >= end), default=-1)))
    return out


def _class(c: str) -> str:
    """A character as the model sees it: its script, or itself if it is no letter or digit."""
    return "digit" if c.isdigit() else _kind(c) if c.isalpha() or ord(c) > 0x900 and c.isprintable() and not c.isspace() and c not in _STARTERS and c not in _CLOSE else c


def _shape(word: str) -> str:
    """Case and digits of a word, runs shortened."""
    if not word:
        return ""
    if word.isdigit():
        return f"d{min(len(word), 3)}"
    flat = re.sub(r"(.)\1+", r"\1\1", "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else "c" if c.isalpha() else c for c in word))
    return flat if len(word) < 4 else flat[:6] + "+"


def view(s: str, spot: Spot, ja: bool) -> tuple[str, ...]:
    """What stands around a spot: the characters of the mark, the words beside it, quotes and scripts."""
    i, j, end, opened, around = spot
    n, t = len(s), s[i:j]
    mark = "gap" if t[0] in " \t\u00a0" else t if len(t) == 1 else ".." if set(t) <= {".", "…"} else t[-2:]
    p = i
    while p > 0 and s[p - 1] in " \t":
        p -= 1
    set_off = "_" if p < i else ""
    k = s.rfind(" ", max(0, p - 24), p) + 1 if mark != "gap" else max(0, p - 1)
    word = s[max(k, p - 24) : p].lstrip("([{«“„\"'¿¡*_`‘")
    k2 = s.rfind(" ", max(0, k - 24), max(0, k - 1)) + 1
    ahead = s[k2 : max(0, k - 1)][-10:].lower() if k > 1 else ""
    prev = _class(s[p - 1]) if p else ""
    if prev in ("cjk", "thai"):
        word = ""
    q = end
    # openers, blanks and pictographs are passed over
    while q < n and (s[q] in _STARTERS or s[q] in " \t\u00a0\u3000" or s[q] > "\u2100" and category(s[q]) == "So"):
        q += 1
    found = _WORD.match(s, q)
    after = "" if q >= n else _class(s[q])
    nxt = "" if not found else found.group()[:1] if after in ("cjk", "thai") else found.group()[:12]
    shape = "end" if q >= n else "name" if s[q].islower() and _NAME.match(s, q) else _shape(nxt[:2]) if nxt else after
    gap = "end" if q >= n else "space" if s[end] in " \t\u00a0\u3000" else "none"
    before = ""
    if opened >= 0:
        k = opened - 1
        while k >= 0 and s[k] in " \t":
            k -= 1
        before = "^" if k < 0 else "w" if s[k].isalnum() or s[k] not in ".!?…。！？｡؟।॥:：,，、;；" and s[k] not in _CLOSE else s[k]
    return (mark, set_off, word[-12:].lower(), _shape(word), ahead, gap, nxt.lower(), shape, s[opened] if opened >= 0 else "", before, s[around] if around >= 0 else "", prev, after, "ja" if ja else "")


def convention(s: str, spot: Spot, ja: bool) -> tuple[str, ...]:
    """How the labelling conventions read a spot: used to annotate training text, never to predict."""
    i, j, end, opened, around = spot
    t, script = s[i:j], "ja" if ja else "any"
    if t[0] in " \t\u00a0":
        a, b = s[i - 1], s[j]
        touch = [x for x in (a, b) if x.isdigit() or (x.isalpha() and _kind(x) == "latin")]
        return ("gap", "touch" if touch or around >= 0 else "blank", "space", "-", "-", "-", script)
    gap = "end" if not s[end:].strip() else "space" if s[end] in " \t\u00a0\u3000" else "none"
    c = t[-1]
    if len(t) > 1 and set(t) <= {".", "…"} or c == "…":
        mark = "dots"
    elif t == ".":
        mark = "dot"
    elif c in "。｡":
        mark = "full"
    elif c in "।॥":
        mark = "danda"
    elif c in ";\u037e":
        mark = "semi"
    else:
        mark = "bang"
    p = i - 1
    while p >= 0 and s[p] in " \t" and mark in ("danda", "bang"):
        p -= 1
    before = "plain"
    prev = s[p] if p >= 0 else ""
    if mark == "semi":
        before = "greek" if prev and _kind(prev) == "greek" else "plain"
    elif mark == "dot" and gap != "none":
        k = s.rfind(" ", 0, i) + 1
        word = s[k:i].lstrip("([{«“„\"'¿¡*_`‘")
        if word in LIST_ENDS:
            before = "list"
        elif word in ABBREVIATIONS:
            before = "abbr"
        elif len(word) == 1 and word.isupper():
            before = "initial"
        elif word.isdigit():
            nxt = _WORD.search(s, end)
            ahead = s[s.rfind(" ", 0, max(k - 1, 0)) + 1 : max(k - 1, 0)]
            before = "ordinal" if nxt and nxt.group() in MONTHS or ahead in ORDINAL_BEFORE and len(word) < 3 else "number"
    if prev and _kind(prev) == "cjk" or t[0] in "。！？｡":
        before = before if before != "plain" else "cjk"
    how = "-"
    shut = "no"
    if opened >= 0:
        shut = "bracket" if s[opened] in _BRACKETS else "quote"
        k = opened - 1
        while k >= 0 and s[k] in " \t":
            k -= 1
        how = "start" if k < 0 or s[k] in ".!?…。！？｡؟।॥" or s[k] in _CLOSE else "colon" if s[k] in ":：" else "mid"
    return (mark, before, "inside" if around >= 0 else gap, _after(s, end), shut, how, script)


def _is_ja(s: str) -> bool:
    return _KANA.search(s) is not None


def label(seen: tuple[str, ...]) -> bool:
    """The conventions that training labels follow: does a sentence end here?"""
    mark, before, gap, after, shut, how, script = seen
    if mark == "gap":
        return before != "touch"
    if gap in ("inside", "end"):
        return False
    wide = before == "cjk"
    if gap == "none" and not wide and mark != "danda":
        return False
    if before in ("abbr", "initial", "ordinal"):
        return False
    if before == "list" and after not in ("upper", "name", "digit"):
        return False
    if mark == "semi" and before != "greek":
        return False
    if after in ("lower", "soft"):
        return False
    if shut != "no" and (wide or after in ("cjk", "to")):
        if shut == "bracket":
            return how == "start"
        return after != "to" if script == "ja" else how == "colon"
    if shut != "no" and after == "caseless":
        return how in ("start", "colon")
    return True


Weights = dict[tuple, float]


def _features(v: tuple[str, ...]) -> list[tuple]:
    """Single observations and small combinations of them; none spans the whole view."""
    mark, off, word, shape, ahead, gap, nxt, nshape, opener, before, around, prev, after, ja = v
    return [
        ("m", mark, off), ("w", word), ("x", nxt), ("s", shape), ("n", nshape), ("g", gap), ("o", opener), ("b", before), ("a", around), ("p", prev), ("f", after),
        ("mn", mark, nshape), ("mgp", mark, gap, prev), ("mgf", mark, gap, after), ("smn", shape, mark, nshape), ("wm", word, mark), ("wn", word, nshape), ("hs", ahead, shape),
        ("sx", shape, nxt), ("ob", opener, before, after), ("obn", opener, before, nshape), ("obj", opener, before, ja, after), ("objx", opener, ja, nxt if ja else ""), ("am", around, mark), ("on", opener, nshape),
        ("gn", gap, nshape), ("mpf", mark, prev, after), ("hsn", ahead, shape, nshape), ("ga", gap, around), ("ox", opener, before, nxt), ("mgn", mark, gap, nshape),
    ]


def viterbi(scores: list[float], w: Weights) -> list[bool]:
    """The best tag sequence; a score is for boundary, against inside."""
    if not scores:
        return []
    stay, turn = w.get(("t", False, True), 0.0), w.get(("t", True, True), 0.0)
    back: list[tuple[bool, bool]] = []
    no, yes = 0.0, scores[0]
    for x in scores[1:]:
        b_no = yes > no
        b_yes = yes + turn > no + stay
        back.append((b_no, b_yes))
        no, yes = max(no, yes), x + max(no + stay, yes + turn)
    tag = yes > no
    out = [tag]
    for b_no, b_yes in reversed(back):
        tag = b_yes if tag else b_no
        out.append(tag)
    return out[::-1]


class Tagger:
    """Weights of the chain; scores of views are kept, for they repeat."""

    def __init__(self, weights: Weights) -> None:
        self.weights, self.known = weights, {}

    def tags(self, s: str, at: list[Spot]) -> list[bool]:
        if len(self.known) > KNOWN:
            self.known.clear()
        ja, get, scores = _is_ja(s), self.weights.get, []
        for spot in at:
            x = view(s, spot, ja)
            v = self.known.get(x)
            if v is None:
                v = self.known[x] = sum(get(f, 0.0) for f in _features(x))
            scores.append(v)
        return viterbi(scores, self.weights)

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of every sentence, in code points."""
        out: list[tuple[int, int]] = []
        if not text:
            return out

        def put(a: int, b: int) -> None:
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if a < b:
                out.append((a, b))

        for a, b, heading in segments(text):
            if not heading:
                s = text[a:b].translate(_FLAT)
                got = spots(s)
                start = a
                for (_, _, end, _, _), cut in zip(got, self.tags(s, got)):
                    if cut:
                        put(start, a + end)
                        start = a + end
                put(start, b)
            else:
                put(a, b)
        return out


def _stripped(s: str) -> str:
    """A segment in a script without marks, stripped of marks."""
    thai = sum(1 for c in s if "฀" <= c <= "๿")
    return re.sub(r"[.!?…。！？｡؟۔।॥;]+(?=\s|$)", "", s) if 2 * thai > len(s) else s


def chains(text: str | None) -> list[tuple[str, list[Spot], list[bool], list[bool]]]:
    """Annotated text: flat text, spots, labels, and whether a label is known from the layout alone.

    Paragraphs and items that end in a mark and follow one another are also read as one text:
    where the first ended, a sentence ends, whatever the conventions say.
    """
    parts = [_stripped(text[a:b].translate(_FLAT)).strip() for a, b, heading in segments(text or "") if not heading]
    out = []
    for one, two in [*((p, "") for p in parts), *((p, q) for p, q in zip(parts, parts[1:]) if p and q)]:
        s = f"{one} {two}" if two else one
        got, ja = spots(s), _is_ja(s)
        # a quotation left open would reach over the joint
        if not got or two and not any(x[2] == len(one) and x[4] < 0 for x in got):
            continue
        known = [bool(two) and x[2] == len(one) for x in got]
        out.append((s, got, [k or label(convention(s, x, ja)) for k, x in zip(known, got)], known))
    return out


def train(texts: list[str | None], epochs: int = EPOCHS) -> Tagger:
    """An averaged structured perceptron over the chains of annotated texts."""
    data = []
    for text in texts:
        for s, got, gold, _ in chains(text):
            ja = _is_ja(s)
            data.append(([_features(view(s, x, ja)) for x in got], gold))
    w: Weights = defaultdict(float)
    total: Weights = defaultdict(float)
    turn = 1
    for _ in range(epochs):
        wrong = 0
        for feats, gold in data:
            got = viterbi([sum(w.get(f, 0.0) for f in fs) for fs in feats], w)
            turn += 1
            if got != gold:
                wrong += 1
                for i, fs in enumerate(feats):
                    if gold[i] != got[i]:
                        step = 1.0 if gold[i] else -1.0
                        for f in fs:
                            w[f] += step
                            total[f] += turn * step
                for tags, step in ((gold, 1.0), (got, -1.0)):
                    for p, q in zip(tags, tags[1:]):
                        if q:
                            w["t", p, q] += step
                            total["t", p, q] += turn * step
        if not wrong:
            break
    return Tagger({f: v - total[f] / turn for f, v in w.items() if v or total[f]})


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Tagger:
    """A tagger trained on a bounded sample of the documents that hold text."""
    filled = documents.filter(F.length("text") > 0)
    rate = min(1.0, docs / max(1, filled.count()))
    u = F.pmod(F.xxhash64(F.lit("sentences"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # about docs rows of at most chars characters, whatever the size of the corpus
    sample = filled.filter(u < rate).select("doc_id", F.substring("text", 1, chars).alias("text")).collect()
    return train([r.text for r in sorted(sample, key=lambda r: (r.doc_id is None, r.doc_id, r.text))])


def sentences(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """``doc_id, start_at, end_at`` for every sentence of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger.weights)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tagger(shared.value)
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(b.doc_id, b.text):
                got = model.units(text)
                ids += [doc] * len(got)
                starts += [x for x, _ in got]
                ends += [x for _, x in got]
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "start_at": pd.Series(starts, dtype="int64"), "end_at": pd.Series(ends, dtype="int64")})

    slim = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return slim.mapInPandas(cut, "doc_id long, start_at long, end_at long")
