"""Personal data by candidate gradient boosting, DataFrame operations only.

High-recall generators propose overlapping spans: the four base patterns, and looser ones for
written-out addresses, numbers without a plus sign, cards in odd groups and addresses of other
formats. Each candidate gets format and context features; boosted trees score it, and a
threshold calibrated for its kind selects it. Base spans always stay; of the others the best
that touch nothing already chosen are added.

The trees are fitted in numpy on candidates that the same generators find in ``examples()``,
sentences made from templates by a fixed seed: a bounded training set that no document enters.
They are compiled to nested CASE expressions, so that scoring stays inside Spark's own
expressions, one pass over the texts without a shuffle.

Defined results: a null text counts as empty and has no spans. Positions are code points, ends
exclusive. Repeated rows stay repeated; other columns are ignored, and kept by ``redact``. No
rows in, no rows out.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A run is tried from its start or from where the last match ended, and taken
# whole, which finds the same matches without trying every suffix of a long run.
EMAIL_RUN = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{EMAIL_RUN})){EMAIL_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of an address up to 255, leading zeros allowed; zeros alone are 0.
OCTET = "(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"
# The looser patterns, with the kinds that each proposes, and what a text must hold to be searched.
NEEDS = {
    "written": r"@|[(\[]at[)\]]|at [A-Za-z0-9-]++ ?+(?:\.[A-Za-z]|\(dot\)|\[dot\]|dot )",
    "number": r"[0-9](?:[ ().\-/]{0,2}+[0-9]){6}",
    "address": r"[0-9] ?+(?:\[\.\]|\(dot\)|\. |\[dot\]) ?+[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:",
}
LOOSE = {
    "written": (rf"(?<!{EMAIL_RUN}){EMAIL_RUN}++ ?+(?:@|\(at\)|\[at\]|at ) ?+[A-Za-z0-9-]++(?: ?+(?:\.|\(dot\)|\[dot\]|dot ) ?+[A-Za-z0-9-]++)++", ("email",)),
    "number": (r"(?<![0-9A-Za-z])[+(]?+[0-9](?:[ ().\-/]{0,2}+[0-9]){6,}+(?![0-9A-Za-z])", ("phone", "card")),
    "address": (r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?+(?:\[\.\]|\(dot\)|(?<= )\. |\[dot\]) ?+[0-9]{1,3}+){3}(?![0-9A-Za-z.])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ("ip",)),
}
NEAR, FOLDS = 24, 5
CONTEXT = {
    "reach": r"(?i)\b(?:call|tel|phone|fax|mobile|cell|dial|text|whatsapp)",
    "write": r"(?i)\b(?:mail|e-?mail|write|contact|reach|send)",
    "pay": r"(?i)\b(?:card|visa|pay|credit|debit|amex|charge)",
    "host": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "other": r"(?i)\b(?:order|invoice|version|isbn|ref|date|token|key|total|page|item|serial|code|build|id)",
}
#: Sounds of a context: the characters before a span, and after it, that are letters, digits, or end a sentence.
AROUND = {"letter_before": r"[A-Za-z] ?$", "mark_before": r"[:=#] ?$", "digit_before": r"[0-9][ ,;]$"}
FEATURES = ("kind", "base", "chars", "digits", "groups", "first", "last", "longest", "plus", "paren", "dots", "colons", "dashes", "spaces", "slashes", "luhn", "at", "spelt", "letters", "year", *CONTEXT, *AROUND)
SPAN = "struct<kind:int,start:int,end:int,value:string,base:int>"


def located(text: Column, pattern: str, kind: int, base: int) -> Column:
    """The matches of a pattern as spans; what lies between matches tells where they are."""
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, F.lit(1), F.size(values)), F.char_length)
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), F.lit(base).alias("base"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    backwards = F.reverse(F.left(digits(value), F.lit(32)))  # more digits make no card

    def step(acc: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(backwards, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(backwards), F.lit(1))), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{SPAN}>")
    count = lambda x: F.char_length(digits(x["value"]))
    holds = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda x: count(x).between(16, 19) & passes_luhn(x["value"]),
        "phone": lambda x: count(x).between(8, 15),
    }
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    return {k: F.when(needs[k], F.filter(located(text, BASE[k], i, 1), holds[k])).otherwise(none) for i, k in enumerate(KINDS)}


def loose_spans(text: Column) -> list[Column]:
    found = []
    none = F.array().cast(f"array<{SPAN}>")
    for name, (pattern, kinds) in LOOSE.items():
        spans = F.when(text.rlike(NEEDS[name]), located(text, pattern, KINDS.index(kinds[0]), 0)).otherwise(none)
        if "card" in kinds:  # longer runs of digits are no phone number or card
            spans = F.filter(spans, lambda x: F.char_length(digits(x["value"])) <= 19)
        found.append(spans)
        if "card" in kinds:
            found.append(F.transform(F.filter(spans, lambda x: F.char_length(digits(x["value"])).between(13, 19)), lambda x: x.withField("kind", F.lit(2))))
    return found


def features(text: Column, x: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    value = x["value"]
    near = F.substring(text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR)))
    number = lambda c: c.cast("int")
    count = lambda pattern: F.char_length(F.regexp_replace(value, f"[^{pattern}]", ""))
    groups = F.transform(F.filter(F.split(value, "[^0-9A-Za-z]+", -1), lambda g: g != ""), F.char_length)
    return {
        "kind": x["kind"],
        "base": x["base"],
        "chars": F.char_length(value),
        "digits": count("0-9"),
        "groups": F.size(F.split(value, "[^0-9]+", -1)),
        "first": F.coalesce(F.try_element_at(groups, F.lit(1)), F.lit(0)),
        "last": F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0)),
        "longest": F.coalesce(F.array_max(groups), F.lit(0)),
        "plus": number(F.startswith(value, F.lit("+"))),
        "paren": count("("),
        "dots": count("."),
        "colons": count(":"),
        "dashes": count("\\-"),
        "spaces": count(" "),
        "slashes": count("/"),
        "luhn": number(passes_luhn(value)),
        "at": number(F.contains(value, F.lit("@"))),
        "spelt": number(value.rlike(r"(?i)[(\[](?:at|dot)[)\]]|\[\.\]")),
        "letters": count("A-Za-z"),
        "year": number(value.rlike(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9]|[0-3]?[0-9][-/.](?:19|20)[0-9]{2}")),
        **{k: number(near.rlike(p)) for k, p in (CONTEXT | AROUND).items()},
    }


@dataclass(frozen=True)
class Node:
    feature: str = ""
    at_most: float = 0.0
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def expression(self, x: dict[str, Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.at_most, self.left.expression(x)).otherwise(self.right.expression(x))


@dataclass(frozen=True)
class Model:
    prior: float
    trees: tuple[Node, ...]
    thresholds: tuple[float, ...]

    def score(self, x: dict[str, Column]) -> Column:
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + tree.expression(x)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, columns: list[int], depth: int, rate: float) -> tuple[Node, np.ndarray]:
    """A regression tree for one boosting step, cut by ``columns`` only, and what it adds to each row."""
    value = -rate * slope.sum() / (weight.sum() + 1)
    best = (1e-6, 0, 0.0)
    for f in columns if depth else ():
        order = np.argsort(x[:, f], kind="stable")
        v, s, w = x[order, f], np.cumsum(slope[order]), np.cumsum(weight[order])
        cuts = np.flatnonzero(v[1:] != v[:-1])
        cuts = cuts[(cuts >= 3) & (cuts < len(v) - 4)]  # four rows at least on either side
        if len(cuts):
            gains = s[cuts] ** 2 / (w[cuts] + 1) + (s[-1] - s[cuts]) ** 2 / (w[-1] - w[cuts] + 1) - s[-1] ** 2 / (w[-1] + 1)
            at = int(gains.argmax())
            best = max(best, (float(gains[at]), f, float(v[cuts[at]])))
    gain, f, cut = best
    if gain <= 1e-6:
        return Node(value=float(value)), np.full(len(x), value)
    low = x[:, f] <= cut
    (left, a), (right, b) = (grow(x[s], slope[s], weight[s], columns, depth - 1, rate) for s in (low, ~low))
    out = np.empty(len(x))
    out[low], out[~low] = a, b
    return Node(FEATURES[f], cut, 0.0, left, right), out


def boost(x: np.ndarray, y: np.ndarray, family: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, precision: float = 0.9) -> Model:
    """Boosted trees; thresholds by kind on scores that each family of templates gets from trees fitted on the others."""
    scores = np.zeros(len(y))
    for fold in range(FOLDS):
        own = family % FOLDS == fold
        prior, trees = fitted(x[~own], y[~own], rounds, depth, rate)
        scores[own] = [prior + sum(walk(t, row) for t in trees) for row in x[own]]
    p = 1 / (1 + np.exp(-scores))
    thresholds = []
    for kind in range(len(KINDS)):
        own = (x[:, 0] == kind) & (x[:, 1] == 0)
        reached = {float(t): y[own & (p >= t)].mean() for t in np.linspace(0.2, 0.95, 16) if (own & (p >= t)).any()}
        wanted = min(precision, max(reached.values(), default=0.0))  # the lowest threshold that is precise enough, else the most precise
        thresholds.append(min((t for t, r in reached.items() if r >= wanted), default=0.95))
    prior, trees = fitted(x, y, rounds, depth, rate)
    return Model(prior, tuple(trees), tuple(thresholds))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float) -> tuple[float, list[Node]]:
    """Each tree sees the kind and half of the other features, so that no single one decides about formats never seen."""
    rng = np.random.default_rng(5)
    prior = float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
    total, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        columns = [0, *sorted(rng.choice(np.arange(1, x.shape[1]), (x.shape[1] - 1) // 2, replace=False).tolist())]
        tree, gain = grow(x, p - y, p * (1 - p), columns, depth, rate)
        trees.append(tree)
        total += gain
    return prior, trees


def walk(node: Node, row: np.ndarray) -> float:
    while node.left is not None:
        node = node.left if row[FEATURES.index(node.feature)] <= node.at_most else node.right
    return node.value


def luhn_complete(number: str) -> str:
    total = sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(number))))
    return number + str(-total % 10)


def families() -> list[tuple[str, Callable[[random.Random], str], tuple[str, ...]]]:
    """Templates of spans: kind (empty: not personal), a maker of the value, words that stand before it."""
    number = lambda r, k: "".join(r.choices("0123456789", k=k))
    word = lambda r: "".join(r.choices(("an", "er", "tion", "the", "ou", "re", "ich", "eau", "os"), k=r.randint(1, 3)))
    octets = lambda r, s: s.join(str(r.randint(0, 255)) for _ in range(4))
    end = lambda r: r.choice(("com", "org", "net", "io", "de"))

    def card(r: random.Random, between: str, digits: int = 16) -> str:
        n = luhn_complete(number(r, digits - 1))
        return between.join([n[:4], n[4:10], n[10:]] if digits < 16 else [n[i : i + 4] for i in range(0, digits, 4)])

    def masked(r: random.Random) -> str:
        n = number(r, 16)
        return n if not luhn_ok(n) else n[:-1] + str((int(n[-1]) + 1) % 10)

    mail, call, pay, host = ("write to", "mail", "contact:", "email", "reach me:", ""), ("call", "tel.", "phone:", "fax", "mobile", "dial"), ("card", "visa", "pay with", "charge", ""), ("server", "host", "login from", "ip", "")
    none, ref, total = ("", "near", "and"), ("order", "ref", "invoice", "serial", "item", "id", "code"), ("total", "page", "build", "version")
    return [
        ("email", lambda r: f"{word(r)}.{number(r, 2)} (at) {word(r)} (dot) {end(r)}", mail),
        ("email", lambda r: f"{word(r)}[at]{word(r)}[dot]{end(r)}", mail),
        ("email", lambda r: f"{word(r)} at {word(r)} dot {end(r)}", mail[:-1]),
        ("email", lambda r: f"{word(r)} @ {word(r)}.{end(r)}", mail),
        ("email", lambda r: f"{word(r)}{number(r, 1)} [at] {word(r)} . {end(r)}", mail),
        ("phone", lambda r: f"({number(r, 3)}) {number(r, 3)}-{number(r, 4)}", (*call, "")),
        ("phone", lambda r: f"{number(r, 3)}-{number(r, 3)}-{number(r, 4)}", call),
        ("phone", lambda r: f"{number(r, 3)}.{number(r, 3)}.{number(r, 4)}", call),
        ("phone", lambda r: f"0{number(r, 2)} {number(r, 4)} {number(r, 4)}", call),
        ("phone", lambda r: f"1-800-{number(r, 3)}-{number(r, 4)}", call),
        ("phone", lambda r: f"00{number(r, 2)} {number(r, 3)} {number(r, 6)}", call),
        ("phone", lambda r: f"{number(r, 3)} {number(r, 3)} {number(r, 4)}", call),
        ("phone", lambda r: f"+{number(r, 2)} {number(r, 3)} {number(r, 3)} {number(r, 4)}", (*call, "")),
        ("card", lambda r: card(r, "."), pay),
        ("card", lambda r: card(r, " ", 15), pay),
        ("card", lambda r: card(r, "-"), pay),
        ("card", lambda r: card(r, "  "), pay),
        ("card", lambda r: card(r, "/"), pay),
        ("card", lambda r: card(r, "-", 15), pay),
        ("card", lambda r: card(r, ".", 15), pay),
        ("card", lambda r: card(r, "", 15), pay[:-1]),
        ("card", lambda r: card(r, " ", 14), pay),
        ("card", lambda r: card(r, "/", 14), pay),
        ("ip", lambda r: octets(r, "[.]"), host),
        ("ip", lambda r: octets(r, " . "), host[:-1]),
        ("ip", lambda r: octets(r, "[dot]"), host),
        ("ip", lambda r: octets(r, "(dot)"), host),
        ("ip", lambda r: octets(r, "."), host),
        ("ip", lambda r: ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), host),
        ("ip", lambda r: ":".join(f"{r.randint(0, 65535):04x}" for _ in range(8)), host),
        ("ip", lambda r: ":".join(f"{r.randint(0, 65535):X}" for _ in range(8)), host),
        ("ip", lambda r: ":".join(["2001", "db8", *(f"{r.choice((0, r.randint(0, 65535))):x}" for _ in range(6))]), host),
        ("ip", lambda r: octets(r, " (dot) "), host),
        ("ip", lambda r: octets(r, " [.] "), host),
        ("email", lambda r: f"{word(r)}-{word(r)} (at) {word(r)}.{end(r)}", mail),
        ("email", lambda r: f"{word(r)}_{word(r)} at {word(r)}.{word(r)} dot {end(r)}", mail[:-1]),
        ("phone", lambda r: f"({number(r, 3)}) {number(r, 4)} {number(r, 4)}", call),
        ("phone", lambda r: f"({number(r, 3)}).{number(r, 3)}.{number(r, 4)}", (*call, "")),
        ("phone", lambda r: f"0{number(r, 3)}-{number(r, 6)}", call),
        ("phone", lambda r: f"00{number(r, 1)}-{number(r, 3)}-{number(r, 3)}-{number(r, 4)}", call),
        ("phone", lambda r: number(r, 10), call),
        ("", lambda r: f"{r.randint(1990, 2030)}-{number(r, 2)}-{number(r, 2)} {number(r, 2)}", ("date", "on", "")),
        ("", lambda r: f"{number(r, 2)}/{number(r, 2)}/{r.randint(1990, 2030)} {number(r, 4)}", ("date", "from", "")),
        ("", lambda r: f"{r.randint(1990, 2030)}.{number(r, 2)}.{number(r, 2)}", ("date", "")),
        ("", lambda r: number(r, r.randint(7, 12)), (*ref, *none)),
        ("", lambda r: f"{number(r, 3)}-{number(r, 4)}-{number(r, 3)}", ref),
        ("", lambda r: f"978-{number(r, 1)}-{number(r, 4)}-{number(r, 4)}-{number(r, 1)}", ("isbn", "")),
        ("", lambda r: masked(r), (*ref, *none)),
        ("", lambda r: number(r, r.randint(13, 15)), (*ref, *none)),
        ("", lambda r: f"{number(r, 3)} {number(r, 3)} {number(r, 3)} {number(r, 2)}", (*total, *none)),
        ("", lambda r: f"{number(r, 2)}.{number(r, 3)}.{number(r, 3)}", (*total, *none)),
        ("", lambda r: f"{number(r, 3)} {number(r, 3)} {number(r, 4)}", (*total, *none)),
        ("", lambda r: f"{number(r, 4)} / {number(r, 4)}", (*total, *none)),
        ("", lambda r: f"{word(r)} at {word(r)}. {word(r)}", ("", "look", "meet")),
        ("", lambda r: f"look at {word(r)} dot {word(r)}", none),
        ("", lambda r: f"{word(r)} at {word(r)}.{word(r)}", ("", "look", "stay")),
        ("", lambda r: "".join(r.choices("0123456789abcdef", k=40)), ("token =", "key", "")),
        ("", lambda r: ":".join(number(r, 2) for _ in range(8)), ("time", "code", "")),
        ("", lambda r: ":".join(number(r, 1) for _ in range(8)), ("score", "code", "")),
        ("", lambda r: ":".join(f"{r.randint(0, 255):02x}" for _ in range(8)), ("key", "token", "")),
        ("", lambda r: f"979 {number(r, 2)} {number(r, 4)} {number(r, 3)} {number(r, 1)}", ("isbn", "book", "")),
        ("", lambda r: f"978{number(r, 10)}", ("isbn", "")),
        ("", lambda r: f"{number(r, 1)}.{number(r, 2)}.{number(r, 4)}.{number(r, 3)}", ("version", "build", "")),
        ("", lambda r: f"{number(r, 2)}-{number(r, 6)}-{number(r, 2)}", ref),
        ("", lambda r: f"{word(r)} at {word(r)}.{word(r)}.{word(r)}", ("", "was", "the")),
        ("", lambda r: f"{word(r)} at {word(r)} . {word(r)}", ("", "was")),
        ("", lambda r: f"{number(r, 4)}-{number(r, 4)}-{number(r, 4)}", (*ref, "")),
    ]


def luhn_ok(number: str) -> bool:
    return luhn_complete(number[:-1]) == number


def examples(each: int = 28, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(text, personal value or empty, kind, family): ``each`` sentences of every family."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(("an", "er", "tion", "the", "ou", "re", "ich", "eau", "os"), k=rng.randint(1, 3)))
    out = []
    for family, (kind, make, before) in enumerate(families()):
        for _ in range(each):
            a, b = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
            value = make(rng)
            out.append((f"{a} {rng.choice(before)} {value} {b}.", value if kind else "", kind, family))
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """rows (…, text) with the spans of the base patterns by kind (``base``) and of the looser ones (``loose``)."""
    text = F.col("text")
    return rows.select("*", F.concat(*base_spans(text).values()).alias("base"), F.concat(*loose_spans(text)).alias("loose"))


def apart(found: DataFrame) -> DataFrame:
    """Without the looser spans that touch a base span, as these couldn't be added."""
    free = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    return found.withColumn("loose", F.filter("loose", free))


def measured(spark: SparkSession, made: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Features of every candidate in sentences of ``examples``, then family and whether it is right."""
    lines = F.lit("\x01".join("\x02".join((t, v, str(KINDS.index(k) if k else -1), str(f))) for t, v, k, f in made))  # one literal plans faster than many
    parts = spark.range(1).select(F.explode(F.split(lines, "\x01")).alias("line")).select(F.split("line", "\x02").alias("p"))
    table = parts.select(*[F.col("p")[i].alias(c) for i, c in enumerate(("text", "truth"))], *[F.col("p")[i].cast("int").alias(c) for i, c in enumerate(("truth_kind", "family"), 2)])
    rows = apart(candidates(table)).select("text", "truth", "truth_kind", "family", F.explode(F.concat("base", "loose")).alias("x"))
    right = (F.col("x.kind") == F.col("truth_kind")) & F.contains(F.col("truth"), F.col("x.value")) & (F.char_length("x.value") * 2 > F.char_length("truth"))
    table = rows.select(*[c.cast("double").alias(k) for k, c in features(F.col("text"), F.col("x")).items()], F.col("family").cast("double").alias("family"), right.cast("double").alias("right"))
    return np.array(sorted(map(tuple, table.collect())))


@functools.cache
def _trained(session_id: str, spark: SparkSession) -> Model:
    data = measured(spark, examples())
    return boost(data[:, :-2], data[:, -1], data[:, -2].astype(int))


def train(spark: SparkSession) -> Model:
    """The model of this session, fitted once on ``examples()``."""
    return _trained(spark.sparkContext.applicationId, spark)


def find_spans(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns), ``base`` and ``spans``: (kind, start, end, …) by kind, then start."""
    inner = rows.select(F.struct(*[named(c) for c in rows.columns]).alias("row"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    found = apart(candidates(inner))

    def scored(x: Column) -> Column:
        return F.struct(x.alias("span"), F.struct(*[c.alias(k) for k, c in features(F.col("text"), x).items()]).alias("f"))

    limits = F.array(*map(F.lit, model.thresholds))
    weighed = found.withColumn("measured", F.transform("loose", scored)).withColumn(
        "weighed", F.transform("measured", lambda m: m["span"].withField("score", model.score({k: m["f"][k] for k in FEATURES})))
    )
    chosen = F.filter("weighed", lambda x: x["score"] >= F.element_at(limits, x["kind"] + 1))
    ranked = F.array_sort(F.transform(chosen, lambda x: F.struct((-x["score"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))

    def add(acc: Column, x: Column) -> Column:
        span = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(0).alias("base"))
        touches = F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(touches, acc).otherwise(F.concat(acc, F.array(span)))

    spans = F.when(F.size("weighed") > 0, F.array_sort(F.aggregate(ranked, F.col("base"), add))).otherwise(F.col("base"))
    return weighed.select("row", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    found = find_spans(rows, model or train(docs.sparkSession))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    found = found.withColumn("listed", written(F.col("spans")))
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        F.col("listed").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in angle brackets; overlapping spans become one."""
    found = find_spans(docs, model or train(docs.sparkSession), text_col)
    text = F.col("row")[text_col]
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    done = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[(done if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
