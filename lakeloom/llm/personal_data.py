"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments: runs of up to MOST parts (digit groups, or a written-out address)
inside a stretch of text that could hold personal data. Its features look at the whole span, such as how many
digit groups of which lengths it has, the separators between them, how it begins, a check sum and the word
before it. Dynamic programming over at most MOST parts per entity chooses boundaries and types of a stretch
together. Weights are fitted here, by gradient ascent on the conditional likelihood of generated examples
(fixed seed): usual ways to write each kind, and numbers and phrases that are none.

Every place outside the stretches scores as "no entity" under any weights, since each entity needs four
digits or a written "at"; so only stretches are decoded. Base matches always stay, and a segment that
overlaps one is no candidate. Of equal scores the segmentation with fewer entities stays, then the one whose
last entity begins first.

Defined cases: a null text is the empty text and has no span; an empty table gives no rows; base matches that
fail their check are dropped without another try; texts, stretches and parts of any length are read whole and
take time in proportion to them; a text in upper case has the written-out addresses of its lower case; other
columns of the input are not read; a repeated row gives a row each time.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import read, texts
from lakeloom.llm.spans import Span, Taken, span_rows

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ with the local characters before it, back to the last match: the leftmost start."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at)):
            found.append(("email", s, m.end()))
            free = m.end()
        else:
            free = max(free, at)  # no local part reaches back over an @
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    if not ANY_DIGIT.search(text):
        return found
    # a match never ends inside a run of digits, so starts inside one need not be tried
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# The field: stretches, their parts and candidate segments

#: Parts of one entity at most.
MOST = 8
NUMERIC = re.compile(r"(?<![A-Za-z0-9])[0-9][0-9().\x20/:,_-]{2,}[0-9](?![A-Za-z0-9])")
AT = re.compile(r"\x20?[\[({]at[\])}]\x20?|\x20at\x20", re.IGNORECASE | re.ASCII)
PLACE = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII)
NAME = LOCAL - {"%"}
GROUP = re.compile(r"[0-9]+")
WORDS_BEFORE = re.compile(r"(?:(?<![A-Za-z0-9])([A-Za-z]{2,12})[^A-Za-z0-9]{1,3})?(?<![A-Za-z0-9])([A-Za-z]{2,12})[^A-Za-z0-9]{0,4}$")
#: A block of letters and digits right before: what follows goes on with it (account, serial and parcel numbers).
BLOCK_BEFORE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z])[A-Za-z0-9]*[\x20:/_-]{0,2}$")


def written_out(text: str) -> list[tuple[int, int]]:
    """Each written "at" with the name before it, back to the last address, and the place after it."""
    found, free = [], 0
    for m in AT.finditer(text):
        s = m.start()
        while s > free and text[s - 1] in NAME:
            s -= 1
        while s < m.start() and not text[s].isalnum():
            s += 1
        if s < m.start() and m.start() >= free and (p := PLACE.match(text, m.end())):
            found.append((s, p.end()))
            free = p.end()
    return found


def stretches(text: str) -> list[tuple[str, int, int]]:
    found = [("n", *m.span()) for m in NUMERIC.finditer(text)] if ANY_DIGIT.search(text) else []
    return found + [("w", s, e) for s, e in written_out(text)]


def parts_of(text: str, kind: str, start: int, end: int) -> list[tuple[int, int]]:
    """The digit groups of a stretch; a written-out address is one part."""
    return [m.span() for m in GROUP.finditer(text, start, end)] if kind == "n" else [(start, end)]


def features(text: str, kind: str, s: int, e: int, groups: list[tuple[int, int]], before: tuple[str, str], sides: str) -> list[str]:
    """What the whole span text[s:e] looks like. before: the two words before it, or a mark for a block of letters and digits; sides: what stands on either side in its stretch."""
    if kind == "w":
        at = AT.search(text, s, e)
        name, place = text[s : at.start()], text[at.end() : e].lower()
        marked, plain = "at" != at[0].strip().lower(), name.isalpha()
        return ["written", f"marked={marked}", f"plain={plain}", f"marked={marked}&plain={plain}", f"dots={min(3, place.count('dot'))}", f"tail={min(6, len(re.split(r'[^a-z0-9]+', place)[-1] or place))}"]
    sizes = [b - a for a, b in groups]
    gaps = sorted({text[groups[i][1] : groups[i + 1][0]] for i in range(len(groups) - 1)})
    n, k, seps = sum(sizes), len(groups), "|".join(gaps)[:12]
    first = text[groups[0][0] : groups[0][0] + 2]
    lead = first if first in ("00", "01") else first[0] if first[0] in "01" else "other"
    start = "(" if text[s] == "(" else "0" if lead[0] == "0" else "1" if lead == "1" and sizes[0] == 1 else "other"
    parted = "few" if k <= 2 else "some" if k <= 5 else "many"
    out = ["any", f"n={min(n, 20)}", f"groups={min(k, 7)}", f"seps={seps}", f"start={start}", f"start={start}&n={min(n, 20)}", f"start={start}&parted={parted}", f"start={start}&seps={seps}", f"seps={seps}&groups={min(k, 7)}"]
    out += [f"first={min(sizes[0], 7)}", f"last={min(sizes[-1], 7)}", f"widest={min(max(sizes), 7)}", f"narrowest={min(min(sizes), 7)}", f"even={min(sizes) == max(sizes)}"]
    if k <= MOST and n <= 20:
        shape = "-".join(map(str, sizes))
        out += [f"sizes={shape}", f"sizes={shape}&seps={seps}"]
    if 12 <= n <= 19:
        right = luhn("".join(text[a:b] for a, b in groups))
        out += [f"luhn={right}", f"luhn={right}&start={start}"]
    if k == 4 and gaps == ["."]:
        out.append(f"bytes={all(b - a <= 3 and int(text[a:b]) <= 255 for a, b in groups)}")
    if gaps == ["."]:
        padded = any(b - a > 1 and text[a] == "0" for a, b in groups)
        out += [f"padded={padded}", f"padded={padded}&groups={min(k, 7)}"]
    out += [f"sides={sides}", f"sides={sides}&groups={min(k, 7)}"]
    for name, word in zip(("second", "before"), before, strict=True):
        if word:
            out += [f"{name}={word}", f"{name}={word}&n={min(n, 20)}"]
    return out


def segments(text: str, stretch: tuple[str, int, int], taken: Taken | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, list[str]]]]:
    """The parts, and (first part, last part, start, end, features) of each candidate of at most MOST parts."""
    kind, start, end = stretch
    parts = parts_of(text, kind, start, end)
    near = text[max(0, start - 32) : start]
    m, block = WORDS_BEFORE.search(near), bool(BLOCK_BEFORE.search(near))
    before = ("", "#") if block else ((m[1] or "").lower(), m[2].lower()) if m else ("", "")
    found = []
    for i in range(len(parts)):
        for j in range(i, min(len(parts), i + MOST)):
            s, e = parts[i][0], parts[j][1]
            if kind == "n" and sum(b - a for a, b in parts[i : j + 1]) < 4:
                continue
            if s and text[s - 1] == "(" and ")" in text[s:e]:
                s -= 1
            if taken is None or taken.free(s, e):
                sides = ("block" if block else "start" if i == 0 else "digits") + ("" if j == len(parts) - 1 else "+digits")
                found.append((i, j, s, e, features(text, kind, s, e, parts[i : j + 1], before if i == 0 or block else ("", ""), sides)))
    return parts, found


def log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def examples(seed: int = 7, n: int = 1400) -> list[tuple[str, list[Span]]]:
    """Generated texts with their entities: the usual ways to write each kind, and numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(sep: str) -> str:
        body = str(r.choice((3, 4, 5, 6))) + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(r.randint(2, 9)) + num(2), num(3), num(4)
        return r.choice((
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"(0{num(2)}) {num(4)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(4)} {num(6)}", f"0{num(4)} {num(3)} {num(3)}",
            f"00{r.randint(20, 99)} {num(2)} {num(7)}", f"00{r.randint(20, 99)} {num(3)} {num(3)} {num(4)}", f"00{r.randint(20, 99)}-{num(2)}-{num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"0{num(2)}/{num(7)}", f"0{num(3)}-{num(7)}", f"0{num(2)}-{num(3)}-{num(4)}", f"0{num(r.choice((2, 3, 4)))} / {num(r.choice((6, 7)))}", f"{a}.{b}.{c}",
        ))

    def named() -> tuple[str, str]:
        """A number that only the word before it tells."""
        lead = r.choice(("call ", "phone: ", "tel. ", "mobile ", "fax: ", "cell ", "telephone ", "ring "))
        if r.random() < 0.5:
            lead = r.choice(("call", "ring", "text", "reach", "phone", "dial")) + r.choice((" me: ", " me at ", " us: ", " us on ", " her at ", " him on "))
        elif r.random() < 0.2:
            lead = r.choice(("phone number: ", "phone number is ", "tel no ", "mobile no. ", "cell number is "))
        return lead, r.choice((str(r.randint(2, 9)) + num(9), f"{num(3)} {num(4)}", f"{num(3)}-{num(4)}", "0" + num(10), f"{num(4)} {num(4)}"))

    def word(least: int = 3, most: int = 8) -> str:
        return "".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(least, most)))

    def written() -> str:
        end, dot = r.choice(("com", "org", "net", "de")), r.choice((" [dot] ", " (dot) ", ".", "[dot]", "(dot)"))
        if r.random() < 0.7:
            return word() + r.choice(("", "." + word(), num(2))) + r.choice((" [at] ", " (at) ", "[at]", "(at)")) + word() + dot + end
        return word() + r.choice(("." + word(), "_" + word(), num(2))) + " at " + word() + r.choice((" dot ", " dot ", ".")) + end

    def octets() -> str:
        """Four numbers of which one at least is over 255."""
        some = [str(r.randint(0, 255)) for _ in range(4)]
        some[r.randrange(4)] = str(r.randint(256, 999))
        return ".".join(some)

    def serial() -> str:
        """Account, parcel and serial numbers: digits that go on with a block of letters and digits."""
        code = "".join(r.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(r.choice((1, 2, 2, 3))))
        if r.random() < 0.3:  # digits that check like a card's
            return f"{code}{num(2)} {card(' ')}{r.choice(('', ' ' + num(2), ' ' + num(3)))}"
        groups = r.choice(([4] * r.randint(3, 5) + [r.randint(1, 4)], [r.randint(3, 9)], [r.randint(2, 6), r.randint(2, 6)], [3, 3, r.randint(3, 4)]))
        return code + num(r.choice((1, 2, 2, 4))) + r.choice((" ", " ", "-")) + r.choice((" ", " ", "-")).join(map(num, groups))

    def none() -> str:
        if r.random() < 0.2:
            return r.choice((octets, serial))()
        return r.choice((
            f"20{num(2)}-{num(2)}-{num(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.19{num(2)}", f"0{r.randint(1, 9)}.0{r.randint(1, 9)}.20{num(2)}", f"0{r.randint(1, 9)}/{r.randint(10, 28)}/20{num(2)}", f"{r.randint(1, 999)},{num(3)}", f"{r.randint(1, 99)},{num(3)},{num(3)}", f"{r.randint(1, 99)},{num(3)},{num(3)}.{num(2)}", f"{r.randint(1, 999)},{num(3)}.{num(2)}", f"{r.randint(1, 99)}.{num(3)}.{num(3)}", f"{num(2)}.{num(2)}", f"0.{num(6)}", num(r.randint(4, 20)), str(r.randint(2, 9)) + num(9), str(r.randint(2, 9)) + num(9), "0" + num(r.randint(4, 11)),
            f"{num(4)} {num(4)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}", f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(3)}-{num(2)}", f"{num(3)}-{num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{r.randint(1, 9)}{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(4)}/{num(4)}", f"19{num(2)}-20{num(2)}",
            f"{num(5)} {num(5)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", " ".join(num(r.randint(1, 4)) for _ in range(r.randint(2, 7))), ", ".join(num(r.randint(1, 3)) for _ in range(r.randint(2, 7))), num(16), num(16),
            f"look at {r.choice(('home', 'noon', 'that'))}.then", "he sat at it.is", f"{word()} at {word()} dot {r.choice(('com', 'org', 'net'))}", f"{word()} at {word()}.{word(2, 4)}",
        ))

    made = []
    for _ in range(n):
        text, spans = r.choice(("", "on the ", "see ", "in that ")), []
        for _ in range(r.choice((1, 1, 1, 2))):
            kind = r.choice(("email", "ip", "card", "card", "phone", "phone", "named", "", "", "", "", ""))
            if kind == "named":
                kind, (lead, v) = "phone", named()
                text += lead
            else:
                v = {"email": written, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": lambda: card(r.choice(("", " ", "-", "."))), "phone": phone, "": none}[kind]()
            if kind:
                spans.append((kind, len(text), len(text) + len(v)))
            text += v + r.choice((" and ", " the ", ", of "))
        made.append((text, spans))
    return made


@functools.cache
def fitted(rounds: int = 30, rate: float = 4.0, decay: float = 1e-3) -> dict[str, tuple[float, ...]]:
    """Weights by feature, one for each kind: full-batch gradient ascent on the field's log likelihood."""
    data, names = [], {}
    for text, gold in examples():
        for stretch in stretches(text):
            parts, found = segments(text, stretch)
            if not found:
                continue
            rows = [[names.setdefault(f, len(names)) for f in seg[4]] for seg in found]
            truth = [(q, KINDS.index(k)) for q, seg in enumerate(found) for k, s, e in gold if (seg[2], seg[3]) == (s, e)]
            data.append((len(parts), [(seg[0], seg[1]) for seg in found], rows, truth))
    weight, squares = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
    for _ in range(rounds):
        gradient = -decay * len(data) * weight
        for n, where, rows, truth in data:
            score = np.array([weight[x].sum(axis=0) for x in rows])
            each = [log_sum(x) for x in score.tolist()]
            ahead = [0.0] * (n + 1)  # log weight of all ways up to part j
            for j in range(1, n + 1):
                ahead[j] = log_sum([ahead[j - 1], *(ahead[a] + each[q] for q, (a, b) in enumerate(where) if b == j - 1)])
            back = [0.0] * (n + 1)
            for j in range(n - 1, -1, -1):
                back[j] = log_sum([back[j + 1], *(each[q] + back[b + 1] for q, (a, b) in enumerate(where) if a == j)])
            for q, (a, b) in enumerate(where):
                mass = np.exp(ahead[a] + score[q] + back[b + 1] - ahead[n])
                for k in rows[q]:
                    gradient[k] -= mass
            for q, t in truth:
                for k in rows[q]:
                    gradient[k, t] += 1
        squares += gradient**2
        weight += rate / 4 * gradient / np.sqrt(squares)
    return {f: tuple(weight[i].tolist()) for f, i in names.items()}


def best_spans(n: int, scored: list[tuple[int, int, float, Span]]) -> list[Span]:
    """The spans of the best way to cut n parts into entities (first part, last part, score, span) and parts of none, which score 0."""
    ends: dict[int, list[tuple[int, float, Span]]] = {}
    for i, j, score, span in scored:
        ends.setdefault(j, []).append((i, score, span))
    best: list[tuple[float, Span | None, int]] = [(0.0, None, 0)]
    for j in range(n):
        choice = (best[j][0], None, j)
        for i, score, span in ends.get(j, ()):
            if best[i][0] + score > choice[0]:
                choice = (best[i][0] + score, span, i)
        best.append(choice)
    found, j = [], n
    while j:
        _, span, i = best[j]
        if span:
            found.append(span)
        j = i
    return found


def decode(text: str, base: list[Span], weights: dict[str, tuple[float, ...]]) -> list[Span]:
    """The best set of entities outside the base matches, stretch by stretch."""
    todo = stretches(text)
    if not todo:
        return []
    taken, added = Taken(base), []
    for stretch in todo:
        parts, found = segments(text, stretch, taken)
        scored = []
        for i, j, s, e, seen in found:
            rows = [weights[f] for f in seen if f in weights]
            scored += [(i, j, score, (kind, s, e)) for t, kind in enumerate(KINDS) if (score := sum(w[t] for w in rows)) > 0]
        if scored:
            added += best_spans(len(parts), scored)
    # stretches of both sorts may overlap: the earlier start stays
    apart: list[Span] = []
    for x in sorted(added, key=lambda x: (x[1], -x[2])):
        if not apart or x[1] >= apart[-1][2]:
            apart.append(x)
    return apart


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs."""
    weights = fitted()  # a few hundred numbers

    def rows(batches):
        return span_rows(batches, base_spans, lambda text, base: decode(text, base, weights), KINDS, KINDS, ("n_email", "n_ip", "n_card", "n_phone"))

    return texts(docs).mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
