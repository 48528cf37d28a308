"""One consistent form for text that looks the same but is stored in different characters.

A longest-match transducer over grapheme clusters, compiled once per process into a trie from a mapping that is built by rule (Unicode decompositions) plus
tables of look-alike letters by script, and checked for conflicts:

* full-width and half-width forms, ligatures, Roman numerals and letter variants become the plain letters;
* a letter with following accents becomes its composed form, in canonical order of the accents, whatever the order and composition they are stored in;
* characters without width vanish, except where they show: joiners within cursive and Indic scripts and emoji, variation selectors after emoji and
  ideographs, tags of flags. Format characters that are drawn (such as the Arabic signs that enclose numbers) stay;
* every kind of space becomes a space, every kind of line break a line feed;
* letters of other scripts that look like Latin ones become the Latin ones, with their accents, wherever they stand. Because the choice doesn't depend
  on the neighbours, two texts that read the same have the same form; the form is meant for comparing, not for display. Different letters of one script
  never become the same letter, so dotless i stays apart from i.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from itertools import permutations

import regex

# Look-alike letters by script, each string aligned with the Latin letters before it.
ALIKE = {
    "Cyrillic": ("ABEKMHOPCTYXSIJVQWGaeopcyxsijhdqwvl", "АВЕКМНОРСТУХЅІЈѴԚԜԌаеорсухѕіјһԁԛԝѵӏ"),
    "Greek": ("ABEZHIKMNOPTYXCJaopuvcj", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαορυνϲϳ"),
    "Armenian": ("OSULounhq", "ՕՏՍԼօսոհզ"),
    "Cherokee": ("ABCDEGHJKLMPRSTVWZ", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"),
    "Coptic": ("OCPHIKMNTXocp", "ⲞⲤⲢⲎⲒⲔⲘⲚⲦⲬⲟⲥⲣ"),
    "Lisu": ("BPDTGKJCZFMNLSRVHWXYAEIOU", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"),
    "phonetic": ("ag", "ɑɡ"),
}
LATIN_FOR_CYRILLIC, CYRILLIC = ALIKE["Cyrillic"]
LATIN_FOR_GREEK, GREEK = ALIKE["Greek"]

# Characters without width that never show (ranges); those that may show; line breaks other than the line feed.
NO_WIDTH = "\u00ad \u034f \u061c \u115f-\u1160 \u17b4-\u17b5 \u180e \u200b \u200e-\u200f \u202a-\u202e \u2060-\u206f \ufeff \U0001bca0-\U0001bca3 \U0001d173-\U0001d17a \U000e0001"
MAY_SHOW = "\u180b-\u180d \u180f \u200c-\u200d \ufe00-\ufe0f \U000e0020-\U000e007f \U000e0100-\U000e01ef"
BREAKS = "\r\x85\u2028\u2029\x0b\x0c"

# Where characters without width show, as regular expressions of the place just before them (and after).
_CURSIVE = r"[\p{Script=Arabic}\p{Script=Syriac}\p{Script=Mongolian}\p{Script=Nko}\p{Script=Mandaic}\p{Script=Phags_Pa}\p{Script=Adlam}\p{Script=Hanifi_Rohingya}\p{Script=Sogdian}]"
_INDIC = r"[\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Gurmukhi}\p{Script=Gujarati}\p{Script=Oriya}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Khmer}\p{Script=Myanmar}]"
_SHOWN = "|".join([
    rf"(?<={_CURSIVE}\p{{M}}*)[\u200c\u200d](?={_CURSIVE})",
    rf"(?<={_INDIC})[\u200c\u200d]",
    r"(?<=\p{Extended_Pictographic}[\ufe0f\p{Emoji_Modifier}]?)\u200d(?=\p{Extended_Pictographic})",
    r"(?<=\p{Extended_Pictographic})[\ufe0e\ufe0f]",
    r"(?<=[0-9#*])\ufe0f(?=\u20e3)",
    r"(?<=\p{Ideographic})[\ufe00-\ufe02\U000e0100-\U000e01ef]",
    r"(?<=\p{Script=Mongolian})[\u180b-\u180d\u180f]",
    r"(?<=\U0001f3f4[\U000e0020-\U000e007f]*)[\U000e0020-\U000e007f]",
])
#: Forms of clusters that a process keeps.
KNOWN = 1 << 16


class Conflict(ValueError):
    """Two rules give one cluster different forms, one script's letters fall together, or a form isn't final."""


def _members(ranges: str) -> list[str]:
    """The characters of space-separated ranges."""
    out = []
    for r in ranges.split(" "):
        a, b = (r[0], r[-1])
        out += map(chr, range(ord(a), ord(b) + 1))
    return out


class Transducer:
    """``form(text)`` gives the consistent form; ``changes`` counts the clusters that a text has in another form."""

    def __init__(self) -> None:
        table: dict[str, str] = {}

        def rule(source: str, target: str) -> None:
            if table.setdefault(source, target) != target:
                raise Conflict(f"{source!r}: {table[source]!r} and {target!r}")

        for script, (latin, other) in ALIKE.items():
            if len(latin) != len(other) or len(set(latin)) != len(latin):
                raise Conflict(f"the look-alike table of {script}")
            for a, b in zip(other, latin):
                rule(a, b)
        alike = self._alike = dict(table)
        accented = []
        hidden = set(_members(NO_WIDTH))
        for code in range(0x80, 0x2FA20):
            if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF:
                continue
            ch = chr(code)
            kind, decomposition = unicodedata.category(ch), unicodedata.decomposition(ch)
            if kind == "Zs":
                rule(ch, " ")
            elif decomposition.startswith(("<wide>", "<narrow>", "<font>")):
                rule(ch, unicodedata.normalize("NFKC", ch))
            elif decomposition.startswith("<compat>") and (kind == "Nl" or ch == "\u017f" or kind[0] == "L" and len(decomposition.split()) > 2):
                rule(ch, unicodedata.normalize("NFKC", ch))  # Roman numerals, the long s, ligatures and digraphs
            elif decomposition and not decomposition.startswith("<"):
                accented.append(ch)
        for ch in BREAKS:
            rule(ch, "\n")
        rule("\r\n", "\n")
        rule("\t", " ")
        for ch in accented:  # composed letters go by their parts, so that a look-alike base is seen
            parts = unicodedata.normalize("NFD", ch)
            target = self._compose(parts)
            if target != ch:
                rule(ch, target)
            # every order and every partial composition in which the letter may be stored
            if 2 <= len(parts) <= 4 and all(map(unicodedata.combining, parts[1:])):
                for marks in set(permutations(parts[1:])):
                    if unicodedata.normalize("NFD", parts[0] + "".join(marks)) == parts:
                        for k in range(len(marks)):
                            begin = unicodedata.normalize("NFC", parts[0] + "".join(marks[:k]))
                            if len(begin) == 1:
                                rule(begin + "".join(marks[k:]), target)
        for other, latin in alike.items():  # accents on look-alikes whose own script has no composed letter
            for ch in accented:
                parts = unicodedata.normalize("NFD", ch)
                if parts[0] == latin and all(map(unicodedata.combining, parts[1:])):
                    rule(other + parts[1:], unicodedata.normalize("NFC", ch))
        # a form may itself have a form, as a full-width Greek letter has; follow to the end
        for source in table:
            seen = {source}
            while (then := "".join(table.get(c, "" if c in hidden else c) for c in table[source])) != table[source]:
                if then in seen:
                    raise Conflict(f"{source!r} has no final form")
                seen.add(then)
                table[source] = then
        self._single = {ord(k): v for k, v in table.items() if len(k) == 1}
        self._no_width = re.compile("[" + self._class(list(hidden)) + "]+")
        self._all = self._single | {ord(c): None for c in hidden}
        self._trie: dict = {}
        for source, target in table.items():
            node = self._trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        may_show = "".join(MAY_SHOW.split(" "))
        self._not_shown = regex.compile(rf"(?=[{may_show}])(?:(?:{_SHOWN})(*SKIP)(*FAIL)|.)")
        self._may_show = re.compile(f"[{may_show}]")
        # a class within the basic plane compiles to a bitmap; texts that go beyond it are few and take the clusters' way
        basic = [chr(c) for c in range(0x80, 0x10000)]
        # what makes a cluster of several characters: marks, vowels and finals of Hangul, joiners and selectors
        self._several = re.compile("\r\n|[" + self._class([c for c in basic if unicodedata.category(c)[0] == "M" or "\u1161" <= c <= "\u11ff" or self._may_show.match(c)]) + "]")
        self._beyond = re.compile("[\U00010000-\U0010ffff]")
        self._mapped = re.compile("[" + self._class([c for c in map(chr, self._all) if c < "\U00010000"]) + "]+")
        self._clusters = regex.compile(r"\X").findall
        self._known: dict[str, str] = {}
        for target in set(table.values()):
            if self.form(target) != target:
                raise Conflict(f"{target!r} isn't final")

    @staticmethod
    def _class(chars: list[str]) -> str:
        """A regular expression's character class, as ranges."""
        codes, out = sorted(map(ord, chars)), []
        i = 0
        while i < len(codes):
            j = i
            while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
                j += 1
            out.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
            i = j + 1
        return "".join(out)

    def _run(self, m: re.Match) -> str:
        return m.group().translate(self._all)

    def _compose(self, decomposed: str) -> str:
        return unicodedata.normalize("NFC", "".join(self._alike.get(c, c) for c in decomposed))

    def _match(self, text: str, at: int) -> tuple[int, str]:
        """The end and the form of the longest key of the mapping at a place; one character as it is where there is none."""
        node, i, found = self._trie, at, (at + 1, text[at])
        while i < len(text) and (node := node.get(text[i])) is not None:
            i += 1
            if "" in node:
                found = i, node[""]
        return found

    def _cluster(self, cluster: str) -> str:
        """A cluster's form. Accents that the mapping doesn't have on this letter are put in order behind it."""
        known = self._known.get(cluster)
        if known is None:
            end, known = self._match(cluster, 0)
            if end < len(cluster):
                out, at = known, end
                while at < len(cluster):
                    at, more = self._match(cluster, at)
                    out += more
                known = self._compose(unicodedata.normalize("NFD", out))
            if len(self._known) < KNOWN:
                self._known[cluster] = known
        return known

    def _shown(self, text: str) -> str:
        """Without the characters that have no width and don't show."""
        text = self._no_width.sub("", text)
        return self._not_shown.sub("", text) if self._may_show.search(text) else text

    def form(self, text: str) -> str:
        if text.isascii() and "\r" not in text and "\t" not in text and "\v" not in text and "\f" not in text:
            return text
        if not self._several.search(text) and not self._beyond.search(text):
            return self._mapped.sub(self._run, text)  # every cluster is one character
        return "".join(map(self._cluster, self._clusters(self._shown(text))))

    def changes(self, text: str) -> int:
        shown = self._shown(text)
        return len(text) - len(shown) + sum(self._cluster(c) != c for c in self._clusters(shown))


@cache
def transducer() -> Transducer:
    return Transducer()


def consistent_form(text: str | None) -> str | None:
    """The form of one text; null stays null, the empty text stays empty."""
    return None if text is None else transducer().form(text)


WORD = re.compile(r"[^\W_]+")


def words(form: str) -> list[str]:
    """Unbroken runs of letters and digits of a text in consistent form, in lower case."""
    return WORD.findall(form.lower())


if __name__ == "__main__":
    sys.stdout.write(consistent_form(sys.stdin.read()) or "")
