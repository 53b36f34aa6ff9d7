"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns give the base spans. The field scores whole candidate spans of bounded length
and picks boundaries and kinds together; it is trained on the base spans of a bounded
sample, on variants of them that the patterns miss, and on damaged copies that are none.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import itertools
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always ends with its run of digits, so every further one begins with a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octet(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 4 and int(significant or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, per kind leftmost and without overlap, by start and kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and _LOCAL.match(text[begin - 1]):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end(), "email"))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    if _DIGITS.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- candidates -------------------------------------------------------------------------

MAX_TOKENS = 16
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_ANCHOR = re.compile(r"[0-9]|@|[\[(] ?at ?[\])]", re.I)
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])? ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]|[\[(]\.[\])]) ?[A-Za-z0-9-]{1,63}){1,6}", re.I)
_NUMBER_SIGNS = set("+().-/[]")
REACH = 24


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around everything that could belong to a candidate."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        wide = 80 if m[0][0] not in "0123456789" else REACH
        a, b = max(0, m.start() - wide), min(len(text), m.end() + wide)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Token borders of a region, and candidate spans as pairs of border numbers with their kind."""
    tokens = [(m.start(), m[0]) for m in _TOKEN.finditer(text, start, end)]
    borders = [t[0] for t in tokens] + [end]
    place = {p: i for i, p in enumerate(borders)}
    found: set[tuple[int, int, str]] = set()
    for m in _LOOSE_EMAIL.finditer(text, start, end):
        if m.start() in place and m.end() in place:
            found.add((place[m.start()], place[m.end()], "email"))
    for i, (_, first) in enumerate(tokens):
        if not (first[0] in "0123456789+(" and (i == 0 or not tokens[i - 1][1][-1:].isdigit())):
            continue
        digits = groups = dots = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            token = tokens[j][1]
            if token[0] in "0123456789":
                digits, groups = digits + len(token), groups + 1
                if digits > 19:
                    break
                if groups == 4 and dots >= 3 and first[0] not in "+(":
                    found.add((i, j + 1, "ip"))
                if 7 <= digits <= 15:
                    found.add((i, j + 1, "phone"))
                if digits >= 13 and first[0] not in "+(":
                    found.add((i, j + 1, "card"))
            elif token == ".":
                dots += 1
            elif not (token in _NUMBER_SIGNS or token in (" ", "  ")):
                break
    return borders, sorted(found)


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """What the field sees of a whole span: its form, its digits, its check sums, its neighbours."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", span))[:32]
    short = re.sub(r"9+", "9", form)

    def side(c: str) -> str:
        return "none" if not c else "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c

    out = ["", f"short={short}", f"n={len(digits)}", f"left={side(text[start - 1 : start])}", f"right={side(text[end : end + 1])}"]
    if kind == "email":
        out = ["", f"marks={''.join(sorted(set(re.sub('[A-Za-z0-9]', '', span))))}", f"left={side(text[start - 1 : start])}", f"right={side(text[end : end + 1])}", f"tld={bool(re.search(r'[A-Za-z]{2,}$', span))}"]
    elif kind == "ip":
        out = ["", f"short={short}", f"octets={all(map(octet, re.findall('[0-9]+', span)))}", *out[3:]]
    elif kind == "card":
        out += [f"luhn={luhn(digits)}", f"form={form}"]
    else:
        out += [f"form={form}", f"plus={span[0] == '+'}"]
    return [f"{kind}|{f}" for f in out]


@dataclasses.dataclass
class Field:
    """Weights of span features; text outside of spans scores nothing."""

    weights: dict[str, float]
    unseen: float = -1.0

    def score(self, names: list[str]) -> float:
        # a form that training never saw speaks against the span
        return sum(self.weights.get(n, self.unseen) for n in names)

    def lattice(self, text: str, start: int, end: int):
        borders, found = candidates(text, start, end)
        arcs = defaultdict(list)
        for i, j, kind in found:
            arcs[j].append((i, kind, self.score(features(text, borders[i], borders[j], kind))))
        return borders, arcs

    def decode(self, text: str, start: int, end: int, certain: float = 0.9) -> list[Span]:
        """The best segmentation of a region; spans below the posterior ``certain`` are left out."""
        borders, arcs = self.lattice(text, start, end)
        if not arcs:
            return []
        n = len(borders) - 1
        best: list[tuple[float, tuple | None]] = [(0.0, None)]
        for j in range(1, n + 1):
            choice = (best[j - 1][0], None)
            for i, kind, s in arcs.get(j, ()):
                if best[i][0] + s > choice[0]:
                    choice = (best[i][0] + s, (i, kind, s))
            best.append(choice)
        spans, j = [], n
        while j:
            arc = best[j][1]
            if arc:
                spans.append((arc[0], j, arc[1], arc[2]))
                j = arc[0]
            else:
                j -= 1
        if not spans:
            return []
        ahead, back = _sums(n, arcs)
        return [(borders[i], borders[j], kind) for i, j, kind, s in reversed(spans) if math.exp(ahead[i] + s + back[j] - ahead[n]) >= certain]


def _plus(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _sums(n: int, arcs) -> tuple[list[float], list[float]]:
    """Log sums over all segmentations of what stands before, and after, every border."""
    ahead = [0.0]
    for j in range(1, n + 1):
        total = ahead[j - 1]
        for i, _, s in arcs.get(j, ()):
            total = _plus(total, ahead[i] + s)
        ahead.append(total)
    out = defaultdict(list)
    for j, held in arcs.items():
        for i, _, s in held:
            out[i].append((j, s))
    back = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        total = back[i + 1]
        for j, s in out.get(i, ()):
            total = _plus(total, back[j] + s)
        back[i] = total
    return ahead, back


def train(examples: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 1.0, decay: float = 1e-4, seed: int = 7) -> Field:
    """Stochastic gradient ascent on the conditional likelihood of the segmentations."""
    prepared = []
    for text, gold in examples:
        borders, found = candidates(text, 0, len(text))
        place = {p: i for i, p in enumerate(borders)}
        wanted = {(place[a], place[b], kind) for a, b, kind in gold if a in place and b in place}
        arcs = [(i, j, kind, features(text, borders[i], borders[j], kind)) for i, j, kind in sorted(set(found) | wanted)]
        if arcs:
            prepared.append((len(borders) - 1, arcs, wanted))
    weights: dict[str, float] = defaultdict(float)
    order, shuffled = list(range(len(prepared))), random.Random(seed)
    for turn in range(rounds):
        shuffled.shuffle(order)
        step = rate / (1 + turn / 3)
        for x in order:
            n, arcs, wanted = prepared[x]
            scored = defaultdict(list)
            for a, (i, j, kind, names) in enumerate(arcs):
                scored[j].append((i, a, sum(weights[f] for f in names)))
            ahead, back = _sums(n, scored)
            for j, held in scored.items():
                for i, a, s in held:
                    _, _, kind, names = arcs[a]
                    error = ((i, j, kind) in wanted) - math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n]))
                    if abs(error) > 1e-4:
                        for f in names:
                            weights[f] += step * (error / len(names) - decay * weights[f])
    return Field(dict(weights))


def variants(text: str, spans: list[Span], rng: random.Random) -> list[tuple[str, list[Span]]]:
    """A text with each of its spans written another way, or damaged so that it is none."""
    out = []
    for start, end, kind in spans:
        span = text[start:end]
        digits = "".join(c for c in span if c in "0123456789")
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10) if digits else ""
        if kind == "email":
            name, _, host = span.partition("@")
            forms = [f"{name} @ {host}", f"{name}[at]{host}", f"{name} [at] {host}", f"{name}(at){host}", f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host.replace('.', '[dot]')}"]
            none = [f"{name} {host}", f"@{name}"]
        elif kind == "ip":
            forms = [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(.)")]
            parts = span.split(".")
            none = [".".join([*parts[:3], str(rng.randint(256, 999))]), ".".join(parts[:3]), ".".join([*parts, parts[0]])]
        elif kind == "card":
            fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
            forms = [".".join(fours), "/".join(fours), "  ".join(fours), " - ".join(fours)]
            none = [wrong, "-".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), digits[:11]]
        else:
            local = digits[-10:]
            forms = [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"1-{local[:3]}-{local[3:6]}-{local[6:]}"]
            years = " ".join(str(rng.randint(1900, 2030)) for _ in range(rng.randint(2, 5)))
            day = f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
            none = [local, years, day, f"{day} {day}", f"{rng.randint(1, 99)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"{rng.randint(1, 9)},{local[:3]},{local[3:6]}", " ".join(str(rng.randint(0, 999)) for _ in range(6)), f"{local[:3]}-{local[3:6]}"]
        for form, good in [(rng.choice(forms), True), (rng.choice(forms), True), (rng.choice(none), False), (rng.choice(none), False)]:
            shifted = len(form) - len(span)
            kept = [(a + shifted * (a >= end), b + shifted * (b >= end), k) for a, b, k in spans if b <= start or a >= end]
            out.append((text[:start] + form + text[end:], kept + ([(start, start + len(form), kind)] if good else [])))
    return out


def excerpts_of(text: str, width: int) -> Iterator[tuple[str, str, list[Span]]]:
    """(kind, excerpt, its base spans) around every base span of a text; kind "" for stretches that hold a digit or at-sign but no span."""
    base = base_spans(text)
    starts = [s[0] for s in base]
    ends = list(itertools.accumulate((s[1] for s in base), max))
    for start, end, kind in base:
        # no candidate is as long as that
        if end - start > 4 * width:
            continue
        a = max(0, start - 48)
        b = min(len(text), max(a + width, end + 1))
        # a span that the excerpt cuts off teaches nothing
        near = base[bisect.bisect_left(starts, a) : bisect.bisect_left(starts, b)]
        inside = [(s - a, e - a, k) for s, e, k in near if (s > a or not a) and (e < b or b == len(text) == e)]
        yield kind, text[a:b], inside
    for start, end in regions(text):
        for a in range(start, end, width):
            b = min(len(text), a + width)
            before = bisect.bisect_left(starts, b)
            if not before or ends[before - 1] <= a:
                yield "", text[a:b], []


def sample(docs: DataFrame, text: str = "text", excerpts: int = 2048, width: int = 160) -> list[tuple[str, list[Span]]]:
    """At most ``excerpts`` excerpts around base spans of each kind, and as many without any, from all texts.

    Every base span anywhere in a text has its excerpt; hash slots of each kind choose among
    them, so order and partitioning do not matter.
    """

    def run(batches):
        import pyarrow as pa

        least: dict[tuple[str, int], tuple[bytes, str, str]] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for kind, x, spans in excerpts_of(value, width):
                    digest = hashlib.blake2b(x.encode(), digest_size=16).digest()
                    slot = kind, int.from_bytes(digest[:8], "big") % excerpts
                    found = digest[8:], x, listed(spans)
                    if slot not in least or found < least[slot]:
                        least[slot] = found
        rows = [(kind, slot, *found) for (kind, slot), found in least.items()]
        for at in range(0, len(rows), 1024):
            columns = list(zip(*rows[at : at + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string()))], names=["kind", "slot", "h", "x", "spans"])

    rows = docs.select(F.col(text).alias("t")).filter("t RLIKE '[0-9@]'").mapInArrow(run, "kind string, slot int, h binary, x string, spans string")
    slots = rows.groupBy("kind", "slot").agg(F.min(F.struct("h", "x", "spans")).alias("m"))
    out = []
    for x, spans in sorted({(r[0], r[1]) for r in slots.select("m.x", "m.spans").collect()}):
        parts = [s.split(":") for s in spans.split(",") if s]
        out.append((x, [(int(a), int(b), kind) for kind, a, b in parts]))
    return out


def learn(docs: DataFrame, text: str = "text", excerpts: int = 2048, width: int = 160) -> Field | None:
    """The field fitted on at most ``excerpts`` excerpts of ``width`` characters for each kind, and as many without spans.

    A kind without one base span in all of ``docs`` has no positive example: its base
    spans would still be found, but the field adds none to them. None where no text of
    ``docs`` holds a base span of any kind; then the patterns alone remain.
    """
    rng, examples = random.Random(11), []
    for t, spans in sample(docs, text, excerpts, width):
        examples.append((t, spans))
        examples += variants(t, spans, rng)
    return train(examples) if any(spans for _, spans in examples) else None


def find_spans(text: str | None, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text; added spans touch no base span and no other."""
    if not text:
        return [], []
    base = base_spans(text)
    if field is None:
        return base, base
    taken, more, n = sorted(s[:2] for s in base), [], 0
    for start, end in regions(text):
        while n < len(taken) and taken[n][1] <= start:
            n += 1
        inside = [s for s in taken[n:] if s[0] < end] if n < len(taken) and taken[n][0] < end else []
        if inside and not _ANCHOR.search(_blank(text, start, end, inside)):
            continue
        more += [s for s in field.decode(text, start, end) if not any(s[0] < b and a < s[1] for a, b in inside)]
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def _blank(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """A region without what the spans cover."""
    out, at = [], start
    for a, b in spans:
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return " ".join([*out, text[at:end]])


def find(docs: DataFrame, field: Field | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    The counts and the hash are of the base spans, ``spans`` lists all as kind:start:end.
    A NULL text counts as empty and has none; repeated rows each get their answer.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(columns):
        for doc, value in zip(columns["k"], columns["t"]):
            base, spans = find_spans(value, held.value)
            counts = [sum(s[2] == kind for s in base) for kind in KINDS]
            yield doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """A text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with its spans masked in ``text``; all other columns stay as they are, a NULL text too."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index(text)
            values = [t and masked(t, find_spans(t, held.value)[1]) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
