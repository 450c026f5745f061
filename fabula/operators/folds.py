"""Rules that see their own earlier decisions: one ordered pass over each document's lines.

Such a rule can't be a window, since a line's speaker depends on speakers
given to earlier lines by the same rule. Spark deals lines out by document and
sorts them; a task holds one batch of rows and the lines of the document that
it ends in, never a corpus. Consecutive rules run in one pass. A rule that raises on a document leaves that
document as it was, and the document's first line notes it in ``faults``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import in_order
from .mentions import Names

Rule = Callable[["Script"], None]


#: Letters that equal another one without regard to case, but not by ``lower``.
_ODD = re.compile("[\u0130\u1c80-\u1c88]")


class _Words:
    """Whole words without regard to case: a pattern in lower case, which a search in the lower-cased text finds several times faster."""

    def __init__(self, alternatives: str):
        self.plain = re.compile(rf"\b(?:{alternatives})\b")
        self.any_case = re.compile(self.plain.pattern, re.IGNORECASE)

    def search(self, text: str) -> re.Match | None:
        return self.any_case.search(text) if _ODD.search(text) else self.plain.search(text.lower())


_words = _Words


_DIALOG = re.compile(L.DIALOG)
_VERB_HE = _words(rf"(?:{L.VERBS_M})\s+він|він\s+(?:{L.VERBS_M})")
_VERB_SHE = _words(rf"(?:{L.VERBS_F})\s+вона|вона\s+(?:{L.VERBS_F})")
_HE, _SHE, _ME, _SAID = (_words(p) for p in (L.PRONOUNS_M, L.PRONOUNS_F, L.FIRST_PERSON_WORDS, L.VERBS_ANY))
_HE_OR_SHE = (_words(L.CONSENSUS_F), _words(L.CONSENSUS_M))
_TAIL = re.compile(rf"\b(?:{L.PRONOUNS_M}|{L.PRONOUNS_F}|та)\b\s*[.!?…»\"’]*\s*$", re.IGNORECASE)
_TAIL_SHE = re.compile(r"\bта\b\s*[.!?…»\"’]*\s*$", re.IGNORECASE)
_OWN = re.compile(rf"^\s*[{L.DASHES}{L.QUOTES}].*?{L.END_PUNCTUATION}?\s*[{L.DASHES}]\s*{L.NAME}", re.DOTALL)
_CAPITALISED = re.compile(L.NAME)
_CALLED = re.compile(rf"\b({L.NAME})\s*[,!:—]")
_LEAD = re.compile(rf"(?:{L.PAIR_VERBS})\s+\w[\w’'\-]+|\w[\w’'\-]+\s+(?:{L.PAIR_VERBS})", re.IGNORECASE)
_ASKS = re.compile(r"\?|\b(?:ти|ви)\b", re.IGNORECASE)
_FEMININE, _MASCULINE = (re.compile(rf"(?:{v})", re.IGNORECASE) for v in (L.VERBS_F, L.VERBS_M))
#: What follows a name that closes a phrase.
_AFTER_NAME = set(" ,!?:;.…")


def _gender_of_verb(word: str) -> str | None:
    return "F" if _FEMININE.fullmatch(word) else "M" if _MASCULINE.fullmatch(word) else None


_LOOKALIKES = str.maketrans(L.LOOKALIKE_LATIN, L.LOOKALIKE_CYRILLIC)
_LATIN = re.compile(f"[{L.LOOKALIKE_LATIN}]")


def _plain(text: str) -> str:
    """Latin look-alikes as Cyrillic letters."""
    return text.translate(_LOOKALIKES) if _LATIN.search(text) else text


def _bare(text: str) -> str:
    """Without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=64)
def _automaton(gid_of: tuple[tuple[str, str], ...]) -> Names:
    return Names(dict(gid_of))


class Script:
    """One document's lines as lists, and what its legend says.

    about: alias (name to gid), gender (gid to M or F), me, vocatives (form to
    gids), allowed and forbidden (gid to scenes); block and scene: of each line."""

    def __init__(self, lines: pd.DataFrame | Mapping[str, list], about: dict):
        n = len(lines["gid"])
        text = lambda c: [x if isinstance(x, str) else None for x in lines[c]] if c in lines else [None] * n
        self.gid, self.scene = text("gid"), text("scene")
        self.body = [b or "" for b in text("body")]
        self.block = [None if pd.isna(b) else int(b) for b in lines["block_id"]] if "block_id" in lines else [None] * n
        of = lambda k: about.get(k) or {}
        self.alias, self.gender, self.me = of("alias"), of("gender"), about.get("me")
        self.allowed, self.forbidden = of("allowed"), of("forbidden")
        self.names = _automaton(tuple(self.alias.items()))
        self.vocatives = of("vocatives")
        self.forms = _automaton(tuple((v, v) for v in self.vocatives))
        self.audit: list[tuple[int, str, str, str]] = []
        # what bodies say, by line; rules change tags only
        self._addressed: dict[int, list[str]] = {}
        self._lead: dict[int, str | None] = {}
        self._plain: dict[int, str] = {}

    def dialog(self, i: int) -> bool:
        """A tagged line of speech, the narrator's too."""
        return self.gid[i] is not None and bool(_DIALOG.match(self.body[i]))

    def speech(self, i: int) -> bool:
        return self.gid[i] != "#g1" and self.dialog(i)

    def known(self, i: int) -> bool:
        return self.gid[i] not in (None, "#g?", "#g1")

    def addressed(self, i: int) -> list[str]:
        """Characters whose name a body has, followed by a blank, a mark or its end."""
        if i not in self._addressed:
            low = self.body[i].lower()
            found = [a for _, end, a in self.names.find(low) if end == len(low) or low[end] in _AFTER_NAME]
            self._addressed[i] = list(dict.fromkeys(self.alias[a] for a in found))
        return self._addressed[i]

    def lead(self, i: int) -> str | None:
        """The first character named in the first 160 characters of narration that has a verb of speech beside a name."""
        if i not in self._lead:
            gids = (self.alias.get(_plain(w).lower()) or self.alias.get(w.lower()) for w in _CAPITALISED.findall(self.body[i][:160]))
            self._lead[i] = next(filter(None, gids), None) if _LEAD.search(self.body[i]) else None
        return self._lead[i]

    def plain(self, i: int) -> str:
        if i not in self._plain:
            self._plain[i] = _plain(self.body[i])
        return self._plain[i]

    def before(self, i: int, reach: int, gender: str, same_block: bool = False) -> str | None:
        """The nearest known speaker of a gender within ``reach`` lines before one."""
        for k in range(i - 1, max(-1, i - 1 - reach), -1):
            if same_block and self.block[k] != self.block[i]:
                return None
            if self.known(k) and self.gender.get(self.gid[k]) == gender:
                return self.gid[k]
        return None

    def shut_out(self, gid: str, i: int) -> bool:
        """Whether the scene's lists shut a character out of a line."""
        scene = (self.scene[i] or "").lower()
        allowed, shut = self.allowed.get(gid) or [], self.forbidden.get(gid) or []
        return bool(scene) and (bool(allowed) and scene not in allowed or scene in shut)


# --- before the pair of speakers is known ----------------------------------------------------


def pronoun_inline(s: Script) -> None:
    """"said he" or "said she" in an unknown line: the nearest earlier speaker of that gender within five lines."""
    for i, g in enumerate(s.gid):
        if g == "#g?":
            want = "M" if _VERB_HE.search(s.body[i]) else "F" if _VERB_SHE.search(s.body[i]) else None
            s.gid[i] = (want and s.before(i, 5, want)) or g


def pronoun_coreference(s: Script) -> None:
    """An unknown line with a pronoun: the nearest earlier speaker of its gender within six lines, of the same block if there is one.

    Other blocks count where the pronoun ends the line, or the line is speech or has a verb of speech."""
    for i, g in enumerate(s.gid):
        if g != "#g?":
            continue
        body = s.body[i]
        want = "F" if _TAIL_SHE.search(body) or _SHE.search(body) else "M" if _HE.search(body) else None
        if want:
            anywhere = _TAIL.search(body) or _SAID.search(body) or _DIALOG.match(body)
            s.gid[i] = s.before(i, 6, want, same_block=True) or (anywhere and s.before(i, 6, want)) or g


def _start(body: str, most: int = 90) -> str:
    """The first characters of a text without accents and leading blanks; only as much of it is read as they need."""
    out, at = "", 0
    while len(out) < most and at < len(body):
        end = at + 2 * most
        while end < len(body) and unicodedata.combining(body[end]):  # marks are put in order with their letter
            end += 1
        out = (out + "".join(c for c in unicodedata.normalize("NFD", body[at:end]) if not unicodedata.combining(c))).lstrip()
        at = end
    return out[:most]


def called(s: Script, i: int) -> str | None:
    """Whom a line calls in its first ninety characters: the first capitalised word before a mark, else the only character named there; case forms count."""
    start = _start(s.body[i])
    first = _CALLED.search(start)
    gids = s.vocatives.get(_bare(first[1])) if first else None
    if gids and len(gids) == 1:
        return gids[0]
    hits = {g for _, _, form in s.forms.find(start.lower()) for g in s.vocatives[form]}
    return hits.pop() if len(hits) == 1 else None


def vocatives(s: Script) -> None:
    """Who is called doesn't speak: such a speaker becomes unknown; an unknown line gets the only other speaker within five lines."""
    for i in range(len(s.gid)):
        if not s.dialog(i):
            continue
        whom = called(s, i)
        if whom and s.gid[i] == whom:
            s.gid[i] = "#g?"
        elif whom and s.gid[i] == "#g?":
            near = {s.gid[k] for k in range(max(0, i - 5), min(len(s.gid), i + 6)) if s.known(k)} - {whom}
            if len(near) == 1:
                s.gid[i] = near.pop()


# --- the pair --------------------------------------------------------------------------------


def _pair(s: Script, i: int) -> list[str]:
    """The two likeliest speakers around a line: known speech counts twice, each character addressed once, and so does one that a lead-in names."""
    score: Counter = Counter()
    for k in range(max(0, i - 12), min(len(s.gid), i + 13)):
        if s.dialog(k):
            voices = ([s.gid[k]] * 2 if s.gid[k] != "#g?" else []) + s.addressed(k)
        else:
            voices = [s.lead(k)]
        score.update(g for g in voices if g and g != "#g1")
    top = [g for g, _ in score.most_common(2)]
    return top if len(top) == 2 else []


def _earlier(s: Script, i: int, test: Callable[[int], bool]) -> str | None:
    return next((s.gid[k] for k in range(i - 1, -1, -1) if s.known(k) and test(k)), None)


def _locked(s: Script, start: int, pair: list[str], last: str | None) -> int:
    """Two speakers take turns from ``start`` on, up to untagged text; returns where they stop."""
    other = {pair[0]: pair[1], pair[1]: pair[0]}
    turn = other.get(last, pair[0])
    for i in range(start, len(s.gid)):
        if s.gid[i] is None:
            if s.body[i].strip():
                return i
            continue
        named = [g for g in s.addressed(i) if g in other]
        if len(named) == 1:
            s.gid[i] = other[named[0]]
        elif s.me in other and _ME.search(s.body[i]):
            s.gid[i] = s.me
        elif s.gid[i] not in other:
            s.gid[i] = turn
        turn = other[s.gid[i]]
    return len(s.gid)


def pair_lock(s: Script) -> None:
    """From each unknown line on, two speakers take turns; who is addressed answers, a first-person word fits only the first person. Tags of others, the narrator's too, give way until untagged text."""
    i = 0
    while i < len(s.gid):
        if s.gid[i] != "#g?":
            i += 1
            continue
        pair, last = _pair(s, i), _earlier(s, i, s.dialog)
        if not pair and last:
            named = s.addressed(i)
            other = named[0] if len(named) == 1 and named[0] != last else _earlier(s, i, lambda k: s.gid[k] != last)
            pair = [last, other] if other else []
        if pair:
            i = _locked(s, i, pair, last)
            continue
        if s.me and _ME.search(s.body[i]):
            s.gid[i] = s.me
        i += 1


# --- after it --------------------------------------------------------------------------------


def _runs(s: Script, gap: int = 0) -> list[list[int]]:
    """Runs of speech lines; up to ``gap`` blank lines may lie within a run."""
    out, run, blanks = [], [], 0
    for i in range(len(s.gid)):
        if s.speech(i):
            run.append(i)
        elif run and s.gid[i] is None and not s.body[i].strip() and blanks < gap:
            blanks += 1
        else:
            out, run, blanks = out + [run] * bool(run), [], 0
    return out + [run] * bool(run)


def fix_flips(s: Script) -> None:
    """In a block of three or more lines that two speakers dominate (70 %), unknown lines take their turn, and so does a third speaker's only line between both. Lines that name their speaker stay."""
    for run in _runs(s):
        count = Counter(s.gid[i] for i in run if s.known(i))
        top = [g for g, _ in count.most_common(2)]
        if len(run) < 3 or len(top) < 2 or sum(count[g] for g in top) < 0.7 * sum(count.values()):
            continue
        other = {top[0]: top[1], top[1]: top[0]}
        for at, i in enumerate(run):
            left, right = [s.gid[k] for k in run[:at]], [s.gid[k] for k in run[at + 1 :]]
            known = lambda gids, of=None: next((g for g in gids if (g != "#g?" if of is None else g in of)), None)
            last = known(reversed(left), other)
            turn = other.get(last)
            new = None
            if s.gid[i] == "#g?":
                near, two_back = known(reversed(left)), left[-2] if len(left) > 1 and left[-2] != "#g?" else None
                between = two_back if near and near == known(right) and two_back and two_back != near else None
                new = between if between and not s.shut_out(between, i) else turn
            elif s.gid[i] not in other and left.count(s.gid[i]) + right.count(s.gid[i]) == 0 and turn and known(right, other) == turn:
                new = turn
            if new and not _OWN.search(s.body[i]) and not s.shut_out(new, i):
                s.gid[i] = new


def alternate(s: Script) -> None:
    """In runs of four or more lines with exactly two known speakers, turns alternate from the first known one: unknown lines take theirs, and so does a line of the wrong one if the next line's is right.

    Lines that name a speaker, or their own one, stay."""
    for run in _runs(s, gap=1):
        names = list(dict.fromkeys(s.gid[i] for i in run if s.known(i)))
        if len(run) < 4 or len(names) != 2:
            continue
        gids, turn = [s.gid[i] for i in run], names[0]
        other = {names[0]: names[1], names[1]: names[0]}
        for at, i in enumerate(run):
            own = any(s.alias[a] == gids[at] for _, _, a in s.names.find(s.body[i].lower()))
            if not _OWN.search(s.body[i]) and not own:
                before, after = gids[at - 1] if at else None, gids[at + 1] if at + 1 < len(gids) else None
                if gids[at] == "#g?":
                    s.gid[i] = turn
                elif gids[at] != turn and after == turn and before in (None, gids[at], "#g?"):
                    s.gid[i] = gids[at] = turn
            turn = other[turn]


def fill_gaps(s: Script) -> None:
    """An unknown question or address between two lines of one speaker: the last other speaker within twenty lines."""
    for i, g in enumerate(s.gid):
        if g != "#g?" or not s.speech(i) or not _ASKS.search(s.body[i]) or _OWN.search(s.body[i]):
            continue
        left = next((s.gid[k] for k in range(i - 1, max(-1, i - 4), -1) if s.known(k)), None)
        right = next((s.gid[k] for k in range(i + 1, min(len(s.gid), i + 4)) if s.known(k)), None)
        if left and left == right:
            s.gid[i] = next((s.gid[k] for k in range(i - 1, max(-1, i - 21), -1) if s.known(k) and s.gid[k] != left), None) or g


def votes(s: Script, i: int) -> Counter:
    """A line's votes: 3 for a name between a dash and a mark, 2 for the character of a lead-in in the two untagged lines before, 1 for the nearest earlier speaker of its pronoun's gender in the block."""
    out: Counter = Counter()
    body = s.plain(i)
    low = body.lower()
    for start, end, name in s.names.find(low, whole=False):
        if re.search(rf"[.!?…\"”»«„“,]\s*[{L.DASHES}]\s*$", body[:start]) and re.match(rf"\s*[,:{L.DASHES}]", body[end:]):
            out[s.alias[name]] += 3
            break
    for k in range(i - 1, max(-1, i - 3), -1):
        if s.gid[k] is not None:
            break
        told = s.plain(k)
        names, verb = s.names.find(told.lower(), whole=False), _SAID.search(told)
        if names and verb:
            gid = s.alias[names[0][2]]
            if _gender_of_verb(verb[0]) in (None, s.gender.get(gid, _gender_of_verb(verb[0]))):
                out[gid] += 2
                break
    want = next((g for g, p in zip("FM", _HE_OR_SHE, strict=True) if p.search(s.body[i])), None)
    near = want and s.before(i, 6, want, same_block=True)
    if near:
        out[near] += 1
    return out


def consensus(s: Script) -> None:
    """Known speech against its votes; each change is noted.

    A speaker whom the scene shuts out, or whose gender the first verb of speech denies, gives way
    to the best-voted one if that one fits, else to none; any other to the best-voted one that has
    two votes more and fits the scene."""
    for i in range(len(s.gid)):
        if not s.known(i) or not s.speech(i):
            continue
        now, count = s.gid[i], votes(s, i)
        best = max(count, key=count.get, default=None)
        fits = best is not None and not s.shut_out(best, i)
        verb = _SAID.search(s.plain(i))
        want, have = verb and _gender_of_verb(verb[0]), s.gender.get(now)
        if s.shut_out(now, i):
            new, why = (best if fits else "#g?"), "forbidden"
        elif want and have and want != have:
            new, why = (best if fits and s.gender.get(best) == want else "#g?"), "verb_gender_conflict"
        elif fits and best != now and count[best] >= count[now] + 2:
            new, why = best, f"consensus {count[best]}>{count[now]}+2"
        else:
            continue
        s.gid[i] = new
        s.audit.append((i, now, new, why if why.startswith("consensus") else why + ("->demote" if new == "#g?" else "->best")))


BEFORE_PAIR: tuple[Rule, ...] = (pronoun_inline, pronoun_coreference, vocatives)
PAIR: tuple[Rule, ...] = (pair_lock,)
AFTER_PAIR: tuple[Rule, ...] = (fix_flips, alternate, fill_gaps, consensus)
RULES = BEFORE_PAIR + PAIR + AFTER_PAIR
FAULTS = "array<struct<rule:string,error:string>>"


def apply_rules(s: Script, rules: tuple[Rule, ...]) -> list[tuple[str, str]]:
    """Run the rules; one that raises changes nothing and is returned with its error."""
    faults = []
    for rule in rules:
        gid, noted = list(s.gid), len(s.audit)
        try:
            rule(s)
        except Exception as e:  # any fault of a rule on a document is a row of the result, not the job's end
            s.gid = gid
            del s.audit[noted:]
            faults.append((rule.__name__, f"{type(e).__name__}: {e}"))
    return faults


@lru_cache(maxsize=64)
def _legend(spec: str | None) -> dict:
    return json.loads(spec) if spec else {}


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by document as tables of whole documents, and the places where a document begins, the end included."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_pylist()
        before = sum(b.num_rows for b in held)
        starts = [i for i in range(len(ids)) if ids[i] != (ids[i - 1] if i else last)] if held else [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        last = ids[-1]
        if not starts:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])]), [0, *(before + i for i in starts)]
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held), [0, sum(b.num_rows for b in held)]


def fold(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``lines`` after the rules, in order, in one pass by document, with ``reason`` (what ``consensus`` changed) and ``faults`` (on a document's first line, what raised); ``cast`` goes.

    lines: with cast; faults of earlier folds stay."""
    if "faults" not in lines.columns:
        lines = lines.withColumn("faults", F.lit(None).cast(FAULTS))
    first = F.row_number().over(in_order()) == 1
    about = F.to_json(F.struct(*(F.col(f"cast.{c}").alias(c) for c in ("alias", "gender", "me", "vocatives", "allowed", "forbidden"))))
    rows = lines.repartition("doc_id").withColumn("_about", F.when(first, about)).withColumn("faults", F.to_json("faults")).drop("cast", "reason")
    names = [c for c in rows.columns if c != "_about"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in documents(batches):
            read = {c: table.column(c).to_pylist() for c in ("gid", "body", "scene", "block_id", "faults", "_about") if c in table.column_names}
            gids, reasons, noted = [], [None] * table.num_rows, read["faults"]
            for start, end in zip(at, at[1:], strict=False):
                s = Script({c: v[start:end] for c, v in read.items()}, _legend(read["_about"][start]))
                faults = apply_rules(s, rules)
                gids += s.gid
                for i, _, _, why in s.audit:
                    reasons[start + i] = why
                if faults:
                    noted[start] = json.dumps([*json.loads(noted[start] or "[]"), *({"rule": r, "error": e} for r, e in faults)])
            new = {"gid": gids, "reason": reasons, "faults": noted}
            yield from pa.table([pa.array(new[c], pa.string()) if c in new else table.column(c) for c in out_names], out_names).to_batches()

    kinds, out_names = dict(rows.dtypes) | {"reason": "string"}, [*names, "reason"]
    out = rows.sortWithinPartitions("doc_id", "line_no").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out_names))
    return out.withColumn("faults", F.from_json("faults", FAULTS))


def failures(lines: DataFrame) -> DataFrame:
    """(doc_id, rule, error): what raised on a document."""
    return lines.select("doc_id", F.inline("faults"))
