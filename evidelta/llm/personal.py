"""Personal information inside free text: a semi-Markov conditional random field.

A text is cut into segments: mentions of five kinds and, between them, single characters outside any mention. Each
possible mention is scored as a whole span, by features that no single word has: the shape of all its digits, the form of
a name (given name first, initial, nickname, family name first), the parts of an address, how an e-mail address is spelt,
whether the span cuts into a longer run, and the words around it. The text outside scores 0. A segmentation's score is the
sum of its segments' scores, and the best one is found by dynamic programming over spans of bounded length, so that
boundaries and kinds are chosen together: spans that overlap compete, and so do kinds for one span.

Only spans that could be a mention enter the lattice (patterns that give spans freely, in several lengths and for several
kinds); which of them are mentions is the model's decision alone. Lattices fall into short runs of overlapping spans, so a
text of any length costs time in proportion to its length.

The model is trained here, by the gradient of the conditional likelihood over the lattices of TRAINING_ROWS invented
sentences (``personaldata``); nothing of the tables is used. It is a few thousand weights and is made once in a process.

Defined results for odd input: null and empty texts have no mentions and are redacted to themselves; offsets count code
points; repeated rows give repeated mentions; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

from evidelta.llm.personaldata import CUES, GIVEN, invented

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Placeholders of the redacted text.
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
#: Invented texts that the model is trained on, passes over them, step and decay of the weights; features seen less often than RARE are left out.
TRAINING_ROWS, PASSES, STEP, DECAY, RARE = 6_000, 10, 0.1, 1e-5, 6
#: Most digit groups in one span, and least and most digits.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 8, 7, 15

_UP = "A-ZÀ-ÖØ-Þ"
_WORD = rf"[{_UP}][^\W\d_]*(?:['’][^\W\d_]+)?(?:-[{_UP}][^\W\d_]+)*"
_CAP = re.compile(rf"[{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)*")
_PARTICLE = r"(?:[vV][oO][nN](?:\s{1,2}[dD][eE][rR])?|[vV][aA][nN](?:\s{1,2}[dD][eE][rR])?|[dD][eE](?:\s{1,2}[lL][aA])?|[dD][eE][lL]|[dD][iI])"
_NICK = r"[“\"„«‘(][^\W\d_]{2,15}[”\"“»’)]"
_FORWARD = re.compile(rf"(\s{{1,3}}[{_UP}]\.)?(\s{{1,3}}{_NICK})?(\s{{1,3}}{_PARTICLE})?\s{{1,3}}({_WORD})(?:\s{{1,3}}({_WORD}))?(?:\s{{1,3}}({_WORD}))?")
_BACKWARD = re.compile(rf"({_PARTICLE}\s{{1,3}})?(?:({_WORD})\s{{1,3}})?({_WORD}),\s{{1,3}}\Z")
_AFTER_GIVEN = re.compile(rf"(\s{{1,3}}[{_UP}]\.(?!\w))?(\s{{1,3}}{_NICK})?")
_RUN = re.compile(r"\d[\d\s.()/\-‐‑–]{4,}\d(?:-?[A-Z])?(?!\w)")
_GROUP = re.compile(r"[A-Z]?\d+(?:-?[A-Z])?")
_LOCAL = r"[^\W_](?:[\w.+%'-]{0,62}\w)?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot|punto|point|punkt)\s?[\])}]\s?|\s(?:dot|DOT)\s)[\w-]+"
#: What stands between the parts; in the form of a word, it needs a dotted host after it.
_BETWEEN = [f"{a}{w}{b}" for a in ("[", "(", "{", "[ ", "( ") for b in ("]", ")", "}", " ]", " )") for w in ("at", "AT", "At") if (a[0] + b[-1]) in ("[]", "()", "{}") and len(a) == len(b)]
_LOOSE = frozenset(("AT]", "AT)", "[AT]", "(AT)", "At]", "At)", "[At]", "(At)", "[", "(", "]", ")", "at}", "{at}"))
_AT_WORDS = frozenset(("at", "AT", "arroba", "arobase"))
_AT_WORD = re.compile(rf"\s(at|AT|arroba|arobase)\s(?=[\w-]+{_DOT})")
_LOCAL_END = re.compile(rf"{_LOCAL}\Z")
_HOST = re.compile(rf"([\w-]+)((?:{_DOT})*)")
_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Terrace|Ter|Place|Pl|Way|Square|Sq|Parkway|Pkwy|Highway|Hwy|Circle|Cir|Row|Close|Crescent)"
_EN = re.compile(
    rf"\d(?<!\w\d)\d{{0,4}}[a-zA-Z]?\s{{1,2}}(?:[NSEW]{{1,2}}\.?\s{{1,2}}|(?:North|South|East|West)\s{{1,2}})?(?:{_WORD}\s{{1,2}}){{1,3}}({_TYPE})\b(?:(?<=St|Rd|Ln|Dr|Ct|Pl|Sq)\.|(?<=Ave|Ter|Hwy|Cir|Row)\.|(?<=Blvd|Pkwy)\.)?"
    rf"(?:,?\s{{1,2}}(?:Apt|Suite|Ste|Unit|Floor)\b\.?\s{{0,2}}#?\w{{1,6}}|,?\s{{0,2}}#\s?\w{{1,6}})?((?:,?\s{{1,3}}(?:in\s{{1,2}})?{_WORD})(?:,\s{{1,2}}[A-Z]{{2}}\s{{1,2}}\d{{5}}(?:-\d{{4}})?)?)?"
)
_FR = re.compile(
    rf"\d(?<!\w\d)\d{{0,3}}(?:\s?(?:bis|ter|quater))?,?\s{{1,2}}(rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route)\s{{1,2}}(?:de\s{{1,2}}la\s{{1,2}}|de\s{{1,2}}l['’]|de\s{{1,2}}|du\s{{1,2}}|des\s{{1,2}}|d['’])?{_WORD}((?:,|\s)\s{{0,2}}\d{{5}}\s{{1,2}}{_WORD})?"
)
_ES = re.compile(
    rf"(?:\b(Calle|Avda|Avenida|Plaza|Pza|Paseo|Camino|Ronda|Travesía)\b\.?|\b(C)/)\s{{0,2}}(?:de\s{{1,2}}la\s{{1,2}}|de\s{{1,2}}los\s{{1,2}}|de\s{{1,2}}|del\s{{1,2}})?{_WORD},?\s{{1,2}}(?:n\.?\s?[º°o]\.?\s{{0,2}}|núm\.?\s{{0,2}})?\d{{1,4}}(?:,\s{{1,2}}\d{{1,2}}\.?[º°ª](?:\s?\w{{1,3}})?)?(,\s{{1,2}}\d{{5}}\s{{1,2}}{_WORD})?"
)
_DE = re.compile(
    rf"\b(?:[{_UP}][^\W\d_]*(straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)|(Am|An\s{{1,2}}der|An\s{{1,2}}den|Im|In\s{{1,2}}der|Zum|Zur|Auf\s{{1,2}}dem)\s{{1,2}}{_WORD}|{_WORD}-(Platz|Straße|Strasse|Weg|Allee|Ring|Gasse))\s{{1,2}}\d{{1,4}}(?:\s?[a-z])?\b(,\s{{1,2}}(?:D-)?\d{{5}}\s{{1,2}}{_WORD})?"
)
_LETTERS, _DIGITS, _UPPER = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"[A-Z]")
_BROKEN = re.compile(r"[.\-]\s|\n\s*\n")
_CAPITALISED = re.compile(rf"[{_UP}]\w+")
_HYPHENED = re.compile(rf"-[{_UP}][^\W\d_]+")
_GIVEN_FORMS = frozenset(f(g) for g in GIVEN for f in (str.upper, str.capitalize))
#: Cues by their last word.
_CUE_ENDS = {c.split(" ")[-1]: c for c in CUES}
_SPACES = re.compile(r"\s{1,3}")
#: Street words; a text without any of a form's words isn't searched for that form.
_TYPES = frozenset(_TYPE[3:-1].split("|"))
_WAYS = frozenset("rue avenue av. boulevard bd place chemin allée impasse quai cours route".split())
_CALLES = frozenset("Calle Avda Avda. Avenida Plaza Pza Pza. Paseo Camino Ronda Travesía C/".split())
_SUFFIXES = ("straße", "strasse", "str.", "weg ", "weg\n", "gasse", "allee", "platz", "ring ", "damm ", "ufer ", "-Platz", "-Straße", "-Strasse", "-Weg", "-Allee", "-Ring", "-Gasse")
_PREPOSITIONS = frozenset(("Am", "Zum", "Zur"))
_NUMBERED = re.compile(r"(?:stra(?:ß|ss)e|str\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|[rR]ing|damm|ufer)\s{1,2}\d")
_DOTS = re.compile(r"\.|\s?[\[({]\s?\w+\s?[\])}]\s?|\sdot\s", re.I)
_COMMA_WORD = re.compile(rf",\s{{1,3}}({_WORD})")
_CAP_END = re.compile(rf"[{_UP}][^\W\d_]+\s{{1,3}}\Z")
_CAP_NEXT = re.compile(rf"\s{{1,3}}[{_UP}][^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+|/s/|[#№]")
_SEPARATORS = {"\n": " ", "\t": " ", "\r": " ", " ": " ", "‐": "-", "‑": "-", "–": "-"}
_SHAPE = str.maketrans({**dict.fromkeys("0123456789", "9"), **_SEPARATORS})

#: A span of the lattice: start, end, kind and features.
Span = tuple[int, int, str, list[str]]


def _before(text: str, at: int) -> list[str]:
    words = _WORDS.findall(text[max(0, at - 32) : at])
    return [w.lower() for w in words[-2:]] or ["^"]


def _around(text: str, start: int, end: int) -> list[str]:
    """What stands next to a span."""
    before = _before(text, start)
    after = text[end : end + 16]
    word = _WORDS.search(after)
    left = text[start - 1 : start].translate(_SHAPE) if start else "^"
    return ["b=" + before[-1], "bb=" + " ".join(before), "a=" + (word.group().lower() if word and word.start() < 4 else ""), "l=" + left, "r=" + after[:1].translate(_SHAPE)]


def _places(text: str, word: str) -> list[int]:
    """Where ``word`` stands in ``text``."""
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


def _numbers(text: str, out: list[Span]) -> None:
    for run in _RUN.finditer(text):
        first = run.start()
        if first and text[first - 1].isalnum():
            if not "A" <= text[first - 1] <= "Z" or (first > 1 and text[first - 2].isalnum()):
                continue
            first -= 1
        groups = list(_GROUP.finditer(text, first, run.end()))
        digits = [sum(map(str.isdigit, g.group())) for g in groups]
        if sum(digits) < LEAST_DIGITS:
            continue
        joins = [text[a.end() : b.start()] for a, b in zip(groups, groups[1:])]
        broken = [len(j) > 3 or _BROKEN.search(j) is not None for j in joins]
        for i in range(len(groups)):
            total = 0
            for j in range(i, min(len(groups), i + GROUPS)):
                if j > i and broken[j - 1]:
                    break
                total += digits[j]
                if total > MOST_DIGITS:
                    break
                if total < LEAST_DIGITS:
                    continue
                start, end = groups[i].start(), groups[j].end()
                if start and text[start - 1] == "+":
                    start -= 1
                if start and text[start - 1] == "(" and 0 <= text.find(")", start, end) - start < 6:
                    start -= 1
                shape = " ".join(text[start:end].translate(_SHAPE).split())
                shape = _UPPER.sub("X", shape)
                cut = ("<" if i and not broken[i - 1] else "") + (">" if j < len(joins) and not broken[j] else "")
                own = _around(text, start, end)
                f = ["s=" + shape, "g=" + ",".join(map(str, digits[i : j + 1])), f"n={total}", "cut=" + cut, "s|b=" + shape + own[0], "first=" + shape[:2], f"last={digits[j]}" + ("n" if j > i and "\n" in joins[j - 1] else "") + text[end : end + 1], *own]
                out.append((start, end, "phone", f))
                out.append((start, end, "id_number", f))


def _emails(text: str, tokens: set[str], out: list[Span]) -> None:
    signs = [(at, at + 1) for at in _places(text, "@")]
    if "at]" in text or "at)" in text or not tokens.isdisjoint(_LOOSE):
        signs += [(at, at + len(w)) for w in _BETWEEN for at in _places(text, w)]
    if not tokens.isdisjoint(_AT_WORDS):
        signs += [m.span(1) for m in _AT_WORD.finditer(text)]
    for at, to in signs:
        at -= at > 0 and text[at - 1].isspace()
        to += text[to : to + 1].isspace()
        local = _LOCAL_END.search(text, max(0, at - 64), at)
        host = _HOST.match(text, to)
        if not local or not host:
            continue
        hosts = _DOTS.split(host.group())
        start, end = local.start(), host.end()
        sign = " ".join(text[at:to].split()) + ("~" if text[at].isspace() else "")
        whole = text[start:end]
        f = [f"at={sign}", f"hosts={min(len(hosts), 4)}", f"tld={hosts[-1].lower()}", f"tldlen={min(len(hosts[-1]), 8)}", f"at|hosts={sign}{min(len(hosts), 4)}", f"at|host={sign}{len(hosts[0])}", "local=" + _LETTERS.sub("x", _DIGITS.sub("9", local.group())), "up" if whole.isupper() else "low", *_around(text, start, end)]
        out.append((start, end, "email", f))


def _addresses(text: str, words: set[str], tokens: set[str], out: list[Span]) -> None:
    forms = [(_EN, "en")] if not _TYPES.isdisjoint(words) else []
    forms += [(p, n) for p, n, needed in ((_FR, "fr", _WAYS), (_ES, "es", _CALLES)) if not needed.isdisjoint(tokens)]
    if not _PREPOSITIONS.isdisjoint(tokens) or any([w in text for w in _SUFFIXES]) and _NUMBERED.search(text):
        forms.append((_DE, "de"))
    for pattern, name in forms:
        for m in pattern.finditer(text):
            kind = next((g for g in m.groups() if g), "").lower()[:12]
            tail, start, whole = m.groups()[-1], m.start(), m.end()
            ends = {whole: "tail" if tail else "whole"}
            if tail:
                ends[whole - len(tail)] = "untailed"
            elif text[whole - 1] == ".":
                ends[whole - 1] = "undotted"
            for end, shape in ends.items():
                f = ["form=" + name, "type=" + kind, "platz" if "-P" in m.group() else "street", shape, *_around(text, start, end)]
                out.append((start, end, "street_address", f))


def _name(text: str, start: int, end: int, form: str, given: str, known: bool, last: str, out: list[Span]) -> None:
    own = _around(text, start, end)
    case = "up" if given.isupper() else "title"
    low = last.lower()
    f = ["known" if known else "unknown=" + given.lower(), "form=" + form, f"k|form={known}{form}", "last=" + low, f"k|last={known}" + low, "sfx=" + low[-3:], "case=" + case + ("" if last.isupper() == given.isupper() else "!"), f"k|{own[0]}{known}", f"f|{own[2]}{form}", *own]
    if form[0] != "G":
        f.append("first=" + text[start:end].split(None, 1)[0].lower())
    if start and _CAP_END.search(text, max(0, start - 24), start):
        f.append("capbefore=" + form)
    if _CAP_NEXT.match(text, end):
        f.append("capafter")
    out.append((start, end, "person_name", f))


def _names(text: str, words: set[str], tokens: set[str], out: list[Span]) -> None:
    for word in words & _GIVEN_FORMS:
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not text[end : end + 1].isalpha() and not text[at - 1 : at].isalpha():
                if text[end : end + 1] == "-" and (more := _HYPHENED.match(text, end)):
                    end = more.end()
                _from_given(text, at, end, True, out)
            at = text.find(word, end)
    for word in tokens & _CUE_ENDS.keys():
        cue = _CUE_ENDS[word]
        for at in _places(text, cue):
            after = _SPACES.match(text, at + len(cue))
            first = after and _CAP.match(text, after.end())
            if first and first.group().split("-")[0] not in _GIVEN_FORMS:
                _from_given(text, *first.span(), False, out)


def _from_given(text: str, start: int, end: int, known: bool, out: list[Span]) -> None:
    """The names around a given name that is in the list, or around a word that may be a given or a family name."""
    word = text[start:end]
    ahead = _FORWARD.match(text, end)
    if ahead:
        initial, nick, particle, one, two, three = ahead.groups()
        form = "G" + ("I" if initial else "") + ("Q" if nick else "") + ("P" if particle else "")
        compound = "-" if "-" in one else ""
        _name(text, start, ahead.end(4), form + "S" + compound, word, known, one, out)
        if two:
            _name(text, start, ahead.end(5), form + "SS" + compound, word, known, two, out)
        if three and one in _GIVEN_FORMS:
            _name(text, start, ahead.end(6), form + "SSS", word, known, three, out)
    if not known:
        ahead = _COMMA_WORD.match(text, end)
        if ahead and ahead.group(1) not in _GIVEN_FORMS:
            _name(text, start, ahead.end(), "S,U", ahead.group(1), False, word, out)
        return
    behind = _BACKWARD.search(text, max(0, start - 48), start)
    if behind:
        particle, two, one = behind.groups()
        rest = _AFTER_GIVEN.match(text, end)
        for stop in {end, rest.end(1) if rest.group(1) else end, rest.end()}:
            tail = "I" if stop > end else ""
            if particle:
                _name(text, behind.start(), stop, "PS,G" + tail, word, True, one, out)
            if two:
                _name(text, behind.start(2), stop, "SS,G" + tail, word, True, two, out)
            _name(text, behind.start(3), stop, "S,G" + tail, word, True, one, out)


def lattice(text: str) -> list[Span]:
    """The spans of ``text`` that could be mentions, in order of their starts."""
    out: list[Span] = []
    _numbers(text, out)
    tokens = set(text.split())
    _emails(text, tokens, out)
    words = set(_CAPITALISED.findall(text))
    _addresses(text, words, tokens, out)
    _names(text, words, tokens, out)
    out.sort(key=lambda s: (s[0], s[1]))
    return out


def clusters(spans: list[Span]) -> list[list[Span]]:
    """Runs of overlapping spans; runs don't overlap one another, so each is segmented alone."""
    out: list[list[Span]] = []
    reach = -1
    for span in spans:
        if span[0] >= reach:
            out.append([])
        out[-1].append(span)
        reach = max(reach, span[1])
    return out


def _previous(spans: list[Span]) -> list[int]:
    """For spans in order of their ends: how many of the spans end at or before each one's start."""
    ends = [s[1] for s in spans]
    return [bisect_right(ends, s[0]) for s in spans]


class Field:
    """The model: a weight for each kind and feature."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {k: {} for k in KINDS}

    def score(self, span: Span) -> float:
        get = self.weights[span[2]].get
        return get("", 0.0) + sum([get(f, 0.0) for f in span[3]])

    def best(self, spans: list[Span]) -> list[Span]:
        """The segmentation with the highest score, by dynamic programming over the spans' ends."""
        if len(spans) == 1:
            return spans if self.score(spans[0]) > 0 else []
        spans = sorted(spans, key=lambda s: (s[1], s[0]))
        before = _previous(spans)
        best = [0.0]
        took: list[bool] = []
        for i, s in enumerate(spans):
            with_it = self.score(s) + best[before[i]]
            took.append(with_it > best[i])
            best.append(max(with_it, best[i]))
        out, i = [], len(spans)
        while i:
            if took[i - 1]:
                out.append(spans[i - 1])
                i = before[i - 1]
            else:
                i -= 1
        return out[::-1]

    def mentions(self, text: str | None) -> list[Span]:
        """The mentions of ``text`` in order."""
        if not text:
            return []
        return [s for cluster in clusters(lattice(text)) for s in self.best(cluster)]

    def marginals(self, spans: list[Span]) -> list[float]:
        """The probability of each span; ``spans`` in order of their ends. Forward and backward sums in logarithms."""
        scores, before, n = [self.score(s) for s in spans], _previous(spans), len(spans)
        forward = [0.0]
        for i in range(n):
            forward.append(_log_add(forward[i], scores[i] + forward[before[i]]))
        # probability mass that flows back from the end
        out, reached = [0.0] * n, [-math.inf] * (n + 1)
        reached[n] = 0.0
        for i in range(n, 0, -1):
            if reached[i] == -math.inf:
                continue
            take = reached[i] + scores[i - 1] + forward[before[i - 1]] - forward[i]
            skip = reached[i] + forward[i - 1] - forward[i]
            out[i - 1] += math.exp(take)
            reached[before[i - 1]] = _log_add(reached[before[i - 1]], take)
            reached[i - 1] = _log_add(reached[i - 1], skip)
        return out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], passes: int = PASSES) -> Field:
    """A model for texts with their mentions, by adaptive gradient steps on the conditional likelihood."""
    field, squares = Field(), {k: {} for k in KINDS}
    prepared = []
    for text, truth in rows:
        gold = {(s, e, k) for s, e, k in truth}
        for cluster in clusters(lattice(text)):
            cluster.sort(key=lambda s: (s[1], s[0]))
            prepared.append((cluster, [float(s[:3] in gold) for s in cluster]))
    seen = Counter(f for spans, _ in prepared for span in spans for f in span[3])
    prepared = [([(s, e, k, [f for f in own if seen[f] >= RARE]) for s, e, k, own in spans], wanted) for spans, wanted in prepared]
    order = random.Random(1)
    for _ in range(passes):
        order.shuffle(prepared)
        for spans, wanted in prepared:
            for span, want, p in zip(spans, wanted, field.marginals(spans)):
                gradient = want - p
                if abs(gradient) < 1e-3:
                    continue
                weights, square = field.weights[span[2]], squares[span[2]]
                for f in ("", *span[3]):
                    square[f] = q = square.get(f, 1.0) + gradient * gradient
                    weights[f] = weights.get(f, 0.0) * (1 - DECAY) + STEP * gradient / math.sqrt(q)
    field.weights = {k: {f: round(w, 3) for f, w in ws.items() if abs(w) >= 0.02} for k, ws in field.weights.items()}
    return field


@lru_cache(maxsize=1)
def model() -> Field:
    """The model trained on the invented rows."""
    return train(invented(TRAINING_ROWS))


def redact(text: str | None, mentions: list[Span]) -> str | None:
    """``text`` with typed placeholders in place of its mentions."""
    if not text or not mentions:
        return text
    out, at = [], 0
    for start, end, kind, _ in mentions:
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*out, text[at:]])
