"""Personal data by patterns and by a linear-chain conditional random field.

The patterns of ``base_spans`` are fixed. The field reads the words of a text that hold a
digit or an ``@`` (other words are outside by definition, which cuts the chain there), with
their shape and the words before them as features, and labels each as outside or as the
beginning or inside of an email address, ip address, card or phone number. It is trained
by gradient ascent on a small labelled table (``labelled_table``, or one given) and decoded
by Viterbi over batches of chains of equal length class. Its spans are added where no base span stands.

Defined results: a null text is empty; no text, no spans, and the digest of the empty
string. The n_ columns count base spans, which ``base_sha256`` digests; ``spans`` holds
those and the added ones, n_added counts the latter. Repeated rows are judged alike;
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.llm.shipped import Shipped
from stagecraft.llm.words import batched

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\s]+")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        rest = _DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            out.append((start, rest.end()))
            free = rest.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _HINT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for kind, pattern, low, high in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = _digits(m[0])
                if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return out


# ---- the field ---------------------------------------------------------------------------

def shape(word: str) -> str:
    """Runs of digits by length class, letters and signs as they are classed."""
    out = re.sub(r"[^\W\d_]+", "a", word)
    out = re.sub(r"[0-9]+", lambda m: "d" + ("1" if len(m[0]) < 2 else "2" if len(m[0]) < 3 else
                 "3" if len(m[0]) < 4 else "4" if len(m[0]) < 5 else "7" if len(m[0]) < 8 else
                 "12" if len(m[0]) < 13 else "19" if len(m[0]) < 20 else "x"), out)
    return out[:24]


def luhn_class(text: str) -> str:
    """Whether the digits have the length of a card number, and the check digit of one."""
    digits = _digits(text)
    return str(int(luhn(digits))) if 13 <= len(digits) <= 19 else "-"


def features(words: list[str], before: list[str]) -> list[list[str]]:
    """Feature names of each word of a chain; ``before`` are the two plain words before it."""
    shapes = [shape(w.strip(",.;:!?\"'")) for w in words]
    together = luhn_class("".join(words))
    hints = [b.strip(",.;:!?\"'()").lower()[-12:] for b in before]
    out = []
    for i, word in enumerate(words):
        own = ["s=" + shapes[i], "n=%d" % min(20, len(_digits(word))),
               "at=%d" % ("@" in word), "dots=%d" % min(word.count("."), 4),
               "own=" + luhn_class(word), "all=" + together,
               "alpha=%d" % any(map(str.isalpha, word)), "plus=%d" % word.startswith(("+", "(+")),
               "p=" + (shapes[i - 1] if i else "^"),
               "f=" + (shapes[i + 1] if i + 1 < len(words) else "$")]
        out.append(own + (["h=" + h for h in hints] if i == 0 else []))
    return out


def labelled_table(seed: int = 11, per_kind: int = 25) -> list[tuple[list[str], list[str], list[str]]]:
    """A small labelled table made by rule: words of a chain, words before, labels."""
    draw = np.random.default_rng(seed)

    def digits(n):
        return "".join(map(str, draw.integers(0, 10, n)))

    def card(n=16, good=True):
        number = digits(n - 1)
        last = next(d for d in "0123456789" if luhn(number + d))
        return number + (last if good else str((int(last) + int(draw.integers(1, 10))) % 10))

    def fours(sign):
        number = card()
        return sign.join(number[i : i + 4] for i in range(0, 16, 4))

    def part():
        return str(int(draw.integers(0, 256)))

    plain = ("the of and in la de der und le et with on").split()
    cues = {"email": ["mail", "email", "contact", "write"], "ip": ["ip", "host", "server", "from"],
            "card": ["card", "visa", "account", "pay"], "phone": ["call", "tel", "phone", "fax"]}
    table = []
    for _ in range(per_kind):
        made = {
            "email": [[f"user{digits(2)}@mail{digits(1)}.example.com"], [f"a.b.{digits(2)}@host.org"],
                      ["jan@firm.net"], [f"x{digits(1)}@a-b.co"]],
            "ip": [[".".join(part() for _ in range(4))], [".".join(part() for _ in range(4)) + ":80"]],
            "card": [[card()], fours(" ").split(), [fours("-")], [card(15)], [fours(".")],
                     fours("  ").split()],
            "phone": [["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                      [f"+{digits(2)}", digits(3), digits(4), digits(3)], [f"{digits(3)}-{digits(3)}-{digits(4)}"],
                      [f"+{digits(11)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"]]}
        none = [[f"{draw.integers(1, 4)}.{draw.integers(0, 10)}"], [str(draw.integers(1900, 2030))],
                [digits(1)], [digits(2) + "%"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [digits(5)], [digits(3)],
                [f"{digits(2)}:{digits(2)}"], [f"{draw.integers(1900, 2030)}-{digits(2)}-{digits(2)}"],
                ["".join("0123456789abcdef"[k] for k in draw.integers(0, 16, 40))], ["a" + digits(3)],
                ['"' + "".join("0123456789abcdef"[k] for k in draw.integers(0, 16, 40)) + '"'],
                [digits(7)], [f"{digits(3)}-{digits(2)}"], [card(16, False)], [card(15, False)],
                [digits(12)], [card(16, False)], ["@"], ["@name"], [digits(1) + "," + digits(3)],
                [digits(2), digits(2)], [digits(30)], [f"{digits(1)}.{digits(1)}.{digits(1)}"]]
        for kind, forms in made.items():
            for words in forms:
                cue = [str(draw.choice(plain)), str(draw.choice(cues[kind] + plain))]
                table.append((words, cue, ["B-" + kind] + ["I-" + kind] * (len(words) - 1)))
        for words, labels in (([card(), card()], ["B-card", "B-card"]),
                              ([card(16, False), card()], ["O", "B-card"]),
                              ([card(16, False), card(16, False)], ["O", "O"])):
            table.append((words, [str(draw.choice(plain)) for _ in range(2)], labels))
        for words in none:
            table.append((words, [str(draw.choice(plain)) for _ in range(2)], ["O"] * len(words)))
    return table


@dataclass
class Crf:
    index: dict[str, int]
    emit: np.ndarray       # features x labels
    move: np.ndarray       # labels x labels, with the start as the last row

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for i, names in enumerate(rows):
            known = [self.index[n] for n in names if n in self.index]
            if known:
                out[i] = self.emit[known].sum(axis=0)
        return out

    def decode(self, chains: list[list[list[str]]]) -> list[list[int]]:
        """Viterbi over all chains at once, padded to the longest of its length class."""
        out: list[list[int]] = [[] for _ in chains]
        classes: dict[int, list[int]] = {}
        for i, chain in enumerate(chains):
            classes.setdefault(max(1, len(chain)).bit_length(), []).append(i)
        for members in classes.values():
            sizes = np.array([len(chains[i]) for i in members])
            longest = int(sizes.max())
            emit = np.zeros((len(members), longest, len(LABELS)))
            for k, i in enumerate(members):
                emit[k, : sizes[k]] = self.scores(chains[i])
            best = emit[:, 0] + self.move[-1]
            back = np.zeros((len(members), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                through = best[:, :, None] + self.move[None, :-1]
                back[:, t] = through.argmax(axis=1)
                best = np.where((t < sizes)[:, None], through.max(axis=1) + emit[:, t], best)
            label = best.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                for k in np.flatnonzero(t < sizes):
                    out[members[k]].append(int(label[k]))
                if t:
                    label = np.where(t < sizes, back[np.arange(len(members)), t, label], label)
        return [labels[::-1] for labels in out]


def allowed() -> np.ndarray:
    """0 where a label may follow another, a large loss where not."""
    n = len(LABELS)
    move = np.zeros((n + 1, n))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            for i, was in enumerate((*LABELS, "^")):
                if was[2:] != label[2:] or was == "^":
                    move[i, j] = -50.0
    return move


def train(table=None, rounds: int = 80, rate: float = 0.5, shrink: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient ascent with forward and backward sums."""
    table = labelled_table() if table is None else table
    chains = [(features(list(w), list(b)), [LABELS.index(x) for x in y]) for w, b, y in table if len(w)]
    index = {n: i for i, n in enumerate(sorted({n for c, _ in chains for row in c for n in row}))}
    n, fixed = len(LABELS), allowed()
    emit, move = np.zeros((len(index), n)), np.zeros((n + 1, n))
    known = [[[index[f] for f in row] for row in c] for c, _ in chains]
    for _ in range(rounds):
        d_emit, d_move = np.zeros_like(emit), np.zeros_like(move)
        paths = move + fixed
        for rows, (_, gold) in zip(known, chains):
            e = np.array([emit[r].sum(axis=0) for r in rows])
            ahead = [e[0] + paths[-1]]
            for t in range(1, len(rows)):
                ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + paths[:-1], axis=0) + e[t])
            total = np.logaddexp.reduce(ahead[-1])
            behind = [np.zeros(n)]
            for t in range(len(rows) - 1, 0, -1):
                behind.append(np.logaddexp.reduce(paths[:-1] + (e[t] + behind[-1])[None], axis=1))
            behind.reverse()
            for t, r in enumerate(rows):
                p = np.exp(ahead[t] + behind[t] - total)
                delta = -p
                delta[gold[t]] += 1
                d_emit[r] += delta
                if t:
                    pair = np.exp(ahead[t - 1][:, None] + paths[:-1] + (e[t] + behind[t])[None] - total)
                    d_move[:-1] -= pair
                    d_move[gold[t - 1], gold[t]] += 1
                else:
                    d_move[-1] += delta
        size = len(chains) ** 0.5
        emit += rate * (d_emit / size - shrink * emit)
        move += rate * (d_move / size - shrink * move)
    return Crf(index, emit, move + fixed)


def chains_of(text: str):
    """Runs of words with a digit or an @: (spans, words, the two words before)."""
    done = 0
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        start = hint.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        spans = []
        for word in _WORD.finditer(text, start):
            if not _HINT.search(word[0]):
                break
            spans.append(word.span())
        done = spans[-1][1]
        yield spans, [text[a:b] for a, b in spans], text[max(0, start - 40) : start].split()[-2:]


def added_spans(text: str, base: list[tuple[str, int, int]], chains, labels):
    """The field's spans, trimmed of outer punctuation, where no base span stands."""
    out = []
    for (spans, words, _), marks in zip(chains, labels):
        at = 0
        while at < len(marks):
            name = LABELS[marks[at]]
            to = at + 1
            if name[0] == "B":
                while to < len(marks) and LABELS[marks[to]] == "I-" + name[2:]:
                    to += 1
                start, end = spans[at][0], spans[to - 1][1]
                while start < end and not (text[start].isalnum() or text[start] in "+("):
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
                if start < end and not any(a < end and start < b for _, a, b in base):
                    out.append((name[2:], start, end))
            at = to
    return out


def written(spans) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find_all(texts: list[str | None], model: Crf):
    """(base spans, added spans) of each text; the chains of all texts are decoded together."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    chains = [list(chains_of(t)) for t in texts]
    labels = iter(model.decode([features(w, b) for c in chains for _, w, b in c]))
    return [(b, added_spans(t, b, c, [next(labels) for _ in c]))
            for t, b, c in zip(texts, base, chains)]


def read_labelled(spark: SparkSession) -> DataFrame:
    """The labelled table as a DataFrame: words, before, labels."""
    return spark.createDataFrame(labelled_table(), "words array<string>, before array<string>, "
                                                   "labels array<string>")


def find(docs: DataFrame, model: Crf) -> DataFrame:
    """Digest of the spans of each document: one row per input row, in place."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string()),
                        ("n_added", pa.int64())])
    shared = Shipped(docs.sparkSession, model)

    def fill(batch):
        found = find_all(batch["text"].to_pylist(), shared.value)
        for doc_id, (base, added) in zip(batch["doc_id"].to_pylist(), found):
            yield (doc_id, *(sum(k == kind for k, _, _ in base) for kind in KINDS),
                   hashlib.sha256(written(base).encode()).hexdigest(), written(base + added),
                   len(added))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        batched(schema, fill), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, "
        "n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Crf) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; null stays null."""
    shared = Shipped(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            clean = [t and masked(t, base + added)
                     for t, (base, added) in zip(texts, find_all(texts, shared.value))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
