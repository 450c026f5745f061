r"""Personal data by weak supervision, in DataFrame functions only.

Four kinds have fixed rules (email, ip, card, phone): their spans are always
reported. Further candidates (credentials, numbers written without a country
code, social security numbers, bank accounts, masked addresses) come from
broad patterns. Three labelers vote on each candidate: a strict regex, a
gazetteer of keys and prefixes, and the context before it. They may abstain.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability; a logistic span classifier is trained on the soft
labels it gives and on form features, and decides on each candidate. Both work
on one row for each pattern of votes and features of a kind, so what reaches
the driver has a bound that doesn't depend on the data.

A match's place is the sum of the lengths of all pieces and matches before it,
from ``split`` and ``regexp_extract_all`` with one pattern; offsets count code
points. The patterns hold possessive loops and are anchored at the start of a
run of their characters (or at the last match's end, ``\G``), which gives the
same leftmost matches in linear time.

Defined results: null and empty texts have no spans; rows may repeat, have
null ids and any other columns, which are kept out; without candidates the
classifier adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Base kinds in their order, with the pattern of each.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text without any match of a kind mostly fails.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Further kinds: a broad pattern each. They are tried in this order at each place.
BROAD = {
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+)-])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}(?![A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{14,}+(?![A-Za-z0-9_])",
}
#: A strict form of each further kind.
STRICT = {
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "iban": r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK|UA)[0-9]{2}",
    "masked_email": r"[(\[]at[)\]].*(?:[(\[]dot[)\]]|\.) ?[a-z]{2,6}$",
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp|gho|sk|pk|rk|xoxb)_[A-Za-z0-9_]{16,}|(?=.*[0-9].*[0-9].*[0-9])[A-Za-z0-9_]{20,})$",
}
#: Words and prefixes that go with each kind: before the candidate (lower case), or as its beginning.
GAZETTEER = {
    "ssn": (r"(?:ssn|social security|sozialversicherung|sécurité sociale|seguro social)\W*$", r"^\b$"),
    "local_phone": (r"(?:phone|tel|tel\.|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\W*$", r"^\b$"),
    "iban": (r"(?:iban|account|konto|compte|cuenta)\W*$", r"^\b$"),
    "masked_email": (r"(?:e-?mail|mail|contact|kontakt|correo|courriel)\W*$", r"^\b$"),
    "secret": (r"(?:token|password|passwd|passwort|pwd|secret|api_?key|apikey|access_?key|auth|bearer|credentials?|contraseña|clave|mot de passe)\W*$", r"^(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|rk_|xoxb_|password|token|secret)"),
}
#: Context that assigns or introduces a value, and context that is running prose.
INTRODUCED = r"[=:]\s*[\"']?$"
PROSE = r"[\p{L},] $"
CONTEXT = 32
LABELERS = ("strict", "listed", "context")
FEATURES = ("digits", "long", "mixed", "quoted")
EM_ROUNDS = 60


def _spans(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column], hint: str = "") -> Column:
    """array<struct<kind, start, stop, value, before>> of the valid matches of ``pattern``."""
    empty = "array<struct<kind:string,start:bigint,stop:bigint,value:string,before:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(F.coalesce(x["m"], F.lit("")))
        one = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), x["m"].alias("value"), F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"))
        return F.struct(stop.cast("long").alias("at"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.from_json(F.lit("[]"), empty).alias("out"))
    return F.when(F.contains(text, F.lit(hint)) & text.rlike(pattern), F.aggregate(parts, start, step)["out"]).otherwise(F.from_json(F.lit("[]"), empty))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second one is doubled."""
    d = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(d, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid_base(kind: str) -> Callable[[Column], Column]:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": lambda x: F.length(_digits(x)).between(16, 19) & _luhn(x),
        "phone": lambda x: F.length(_digits(x)).between(8, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind its spans in a text that is not null."""
    return {k: _spans(text, k, p, _valid_base(k), HINT[k]) for k, p in BASE.items()}


def _kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(BROAD.items()):
        inner = p.replace(r"(?<![0-9+] )", "")
        out = F.when(value.rlike(f"^(?:{inner})$"), F.lit(k)).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Spans of all further candidates; kind is not yet set."""
    return _spans(text, "", "|".join(BROAD.values()), lambda x: F.lit(True))


def _by_kind(kind: Column, value: Callable[[str], Column]) -> Column:
    out = F.lit(None).cast("int")
    for k in BROAD:
        out = F.when(kind == k, value(k)).otherwise(out)
    return out


def votes(kind: Column, value: Column, before: Column) -> dict[str, Column]:
    """Each labeler's vote: 1, 0, or -1 where it abstains."""
    low = F.lower(before)
    return {
        "strict": _by_kind(kind, lambda k: value.rlike(STRICT[k]).cast("int")),
        "listed": _by_kind(kind, lambda k: F.when(low.rlike(GAZETTEER[k][0]) | value.rlike(GAZETTEER[k][1]), F.lit(1)).otherwise(F.lit(-1))),
        "context": F.when(before.rlike(INTRODUCED), F.lit(1)).when(before.rlike(PROSE) & (kind == "secret"), F.lit(0)).otherwise(F.lit(-1)),
    }


def features(value: Column, before: Column) -> dict[str, Column]:
    """Form features of a candidate, 0 or 1 each."""
    return {
        "digits": (3 * F.length(_digits(value)) >= F.length(value)).cast("int"),
        "long": (F.length(value) >= 24).cast("int"),
        "mixed": (value.rlike("[0-9][A-Za-z]+[0-9]")).cast("int"),
        "quoted": before.rlike("[\"'(<]$").cast("int"),
    }


def expectation_maximisation(rows: list[dict]) -> dict[str, dict]:
    """By kind: the share of true candidates and, of each labeler, P(votes 1 | true) and P(votes 1 | false), if it votes.

    rows: kind, one vote for each labeler, n. A kind's start is that most votes are right."""
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        mine = [r for r in rows if r["kind"] == kind]
        share, hit, false = 0.5, dict.fromkeys(LABELERS, 0.8), dict.fromkeys(LABELERS, 0.2)
        for _ in range(EM_ROUNDS):
            total = yes = 0.0
            up = {j: [1.6, 2.0, 0.4, 2.0] for j in LABELERS}  # votes 1 and all votes, of true and of false ones; with a prior
            for r in mine:
                p = posterior(r, share, hit, false)
                total, yes = total + r["n"], yes + p * r["n"]
                for j in LABELERS:
                    if r[j] >= 0:
                        for at, w in ((0, p), (2, 1 - p)):
                            up[j][at] += w * r["n"] * r[j]
                            up[j][at + 1] += w * r["n"]
            share = min(max((yes + 1) / (total + 2), 0.01), 0.99)
            hit = {j: u[0] / u[1] for j, u in up.items()}
            false = {j: u[2] / u[3] for j, u in up.items()}
        out[kind] = {"share": share, "hit": hit, "false": false}
    return out


def posterior(r: dict, share: float, hit: dict, false: dict) -> float:
    a, b = math.log(share), math.log(1 - share)
    for j in LABELERS:
        if r[j] == 1:
            a, b = a + math.log(hit[j]), b + math.log(false[j])
        elif r[j] == 0:
            a, b = a + math.log(1 - hit[j]), b + math.log(1 - false[j])
    return 1 / (1 + math.exp(min(b - a, 700)))


def fit(rows: list[dict]) -> dict[str, float]:
    """Weights of a logistic regression on soft labels; rows: kind, votes, features, n."""
    if not rows:
        return {}
    reliability = expectation_maximisation(rows)
    names = ["one", *(f"is_{k}" for k in BROAD), *(f"{j}_yes" for j in LABELERS), *(f"{j}_no" for j in LABELERS), *FEATURES]
    data = []
    for r in rows:
        x = {"one": 1.0, f"is_{r['kind']}": 1.0} | {f"{j}_{'yes' if r[j] else 'no'}": 1.0 for j in LABELERS if r[j] >= 0} | {f: float(r[f]) for f in FEATURES}
        data.append((x, posterior(r, **reliability[r["kind"]]), r["n"]))
    total = sum(n for _, _, n in data)
    w = dict.fromkeys(names, 0.0)
    for _ in range(400):
        g = {k: 1e-3 * v for k, v in w.items()}
        for x, y, n in data:
            p = 1 / (1 + math.exp(-max(min(sum(w[k] * v for k, v in x.items()), 500), -500)))
            for k, v in x.items():
                g[k] += n / total * (p - y) * v
        w = {k: v - 2.0 * g[k] for k, v in w.items()}
    return w


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base and extra: arrays of struct<kind, start, stop, value>.

    ``extra`` has what the span classifier accepts and no base span overlaps."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base_spans(text)
    flat = F.concat(*base.values())
    rows = rows.select("doc_id", F.transform(flat, lambda s: s.dropFields("before")).alias("base"), candidates(text).alias("found"))
    rows = scratch.save(rows, "spans")

    def judged(s: Column) -> Column:
        kind = _kind_of(s["value"])
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), *(c.alias(n) for n, c in (votes(kind, s["value"], s["before"]) | features(s["value"], s["before"])).items()))

    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    told = rows.select("doc_id", "base", F.filter(F.transform("found", judged), lambda s: s["kind"].isNotNull() & apart(s)).alias("found"))
    patterns = told.where(F.size("found") > 0).select(F.explode("found").alias("s")).select("s.*").groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n"))
    w = fit([r.asDict() for r in patterns.orderBy("kind", *LABELERS, *FEATURES).collect()])  # as many rows as patterns exist, at most

    def accepted(s: Column) -> Column:
        if not w:
            return F.lit(False)
        z = F.lit(w["one"])
        for k in BROAD:
            z = z + F.when(s["kind"] == k, F.lit(w[f"is_{k}"])).otherwise(F.lit(0.0))
        for j in LABELERS:
            z = z + F.when(s[j] == 1, F.lit(w[f"{j}_yes"])).when(s[j] == 0, F.lit(w[f"{j}_no"])).otherwise(F.lit(0.0))
        for f in FEATURES:
            z = z + s[f] * F.lit(w[f])
        return z >= 0

    extra = F.transform(F.filter("found", accepted), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
    return told.select("doc_id", "base", extra.alias("extra"))


def digests(found: DataFrame) -> DataFrame:
    """Of ``find``'s rows: counts of the base kinds, the hash of their spans, and all spans as a string."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, line), ",")
    of_kind = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    by_kind = [of_kind("extra", k) for k in BROAD]
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", *by_kind)).alias("spans"))
