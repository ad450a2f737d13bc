"""Text cleaning with built-in column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters of Portuguese, their plain letters, and punctuation.
ACCENTED = "ÇÃÁÀÂÉÊÍÕÓÔÚÜçãáàâéêíõóôúüÈÖÑèöñËëÄä"
PLAIN = "CAAAAEEIOOOUUcaaaaeeiooouuEONeonEeAa"
PUNCTUATION = "“”!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOT_LETTERS = "[^a-z A-ZÁÂÃÀÉÊÍÔÓÕÚÜÇáâãàéêíóôõúüç]"
TAG_DROP = r"[\.,;!:\(\)/]"
# Portuguese stop words.
PT_STOPWORDS = (
    "de a o que e é do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando "
    "muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa "
    "num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes "
    "meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas "
    "isto aquilo estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera "
    "estivéramos esteja estejamos estejam estivesse estivéssemos estivessem estiver estivermos estiverem hei há "
    "havemos hão houve houvemos houveram houvera houvéramos haja hajamos hajam houvesse houvéssemos houvessem houver "
    "houvermos houverem houverei houverá houveremos houverão houveria houveríamos houveriam sou somos são era éramos "
    "eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos forem serei será "
    "seremos serão seria seríamos seriam tenho tem temos tém tinha tínhamos tinham tive teve tivemos tiveram tivera "
    "tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem terei terá teremos terão teria "
    "teríamos teriam"
).split()

_STYLED_STARTS = {  # first code point of A-Z, a-z and, where they exist, 0-9
    "bold sans": (0x1D5D4, 0x1D5EE, 0x1D7EC),
    "bold serif": (0x1D400, 0x1D41A, 0x1D7CE),
    "italic sans": (0x1D608, 0x1D622, None),
    "italic serif": (0x1D434, 0x1D44E, None),
    "bold italic sans": (0x1D63C, 0x1D656, None),
    "bold italic serif": (0x1D468, 0x1D482, None),
}


def _styled_alphabet() -> tuple[str, str]:
    source, target = "", ""
    for upper, lower, digit in _STYLED_STARTS.values():
        for start, first, size in ((upper, "A", 26), (lower, "a", 26), (digit, "0", 10)):
            if start is None:
                continue
            source += "".join(chr(start + i) for i in range(size))
            target += "".join(chr(ord(first) + i) for i in range(size))
    return source + "ℎ", target + "h"  # the italic h lives outside its block


STYLED, UNSTYLED = _styled_alphabet()


RUN_CHARS = 1_000_000  # of texts that are Python strings at a time
HANGUL = range(0xAC00, 0xD7A4)


def _decompositions() -> tuple[dict[str, str], dict[str, str], str]:
    """Compatibility decompositions without marks of all characters: to one character, to none or several, and the marks.

    Hangul syllables stay whole: their letters would name the same words.
    """
    one, many, marks = {}, {}, ""
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or code in HANGUL:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            marks += c
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c:
            (one if len(base) == 1 else many)[c] = base
    return one, many, marks


_ONE, _MANY, _MARKS = _decompositions()
_ONE_FROM, _ONE_TO = "".join(_ONE), "".join(_ONE.values())


def _ranges(characters: str) -> str:
    """Regex class of the characters, runs as ranges."""
    out, codes = "", sorted(map(ord, characters))
    first = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out += f"\\x{{{codes[first]:x}}}-\\x{{{codes[i - 1]:x}}}"
            first = i
    return f"[{out}]"


_MANY_CLASS = _ranges("".join(_MANY))
# A short class that holds all of these and more; most texts have none of it, and the long class is slow to test.
_PERHAPS_MANY = _ranges("".join(c for c in _MANY if c < "\u0250"))[:-1] + r"\x{250}-\x{10ffff}]"
_GAP = "\u0001"  # stands between entries of the constant lists; no decomposition holds it


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition of every character, marks dropped.

    One pass replaces the characters that become a single one. Those that become several (such as the letter
    pair ``ﬁ``) are looked up in a second step, only in texts that hold any.
    """
    plain = F.translate(col, _ONE_FROM + _MARKS, _ONE_TO)
    table = F.map_from_arrays(F.split(F.lit(_GAP.join(_MANY)), _GAP), F.split(F.lit(_GAP.join(_MANY.values())), _GAP))
    longer = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    other = F.when(~plain.rlike(_PERHAPS_MANY), plain).when(plain.rlike(_MANY_CLASS), longer).otherwise(plain)
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(other)  # a text of ASCII is its own result


def squeeze(col: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def remove_accents(col: Column) -> Column:
    """Only the listed letter pairs change (so ì, î, ù or û stay)."""
    return F.translate(col, ACCENTED, PLAIN)


def remove_punctuation(col: Column, whitespace: bool = False) -> Column:
    return F.translate(col, PUNCTUATION, " " * len(PUNCTUATION) if whitespace else "")


def text_to_tag(col: Column) -> Column:
    """Lower case name without spaces or accents, fit for a file name."""
    joined = F.translate(F.lower(remove_accents(squeeze(col))), " ", "_")
    return F.regexp_replace(joined, TAG_DROP, "")


def keep_only_letters(col: Column) -> Column:
    return squeeze(F.regexp_replace(col, NOT_LETTERS, ""))


def remove_stopwords(col: Column, words: Sequence[str] = tuple(PT_STOPWORDS)) -> Column:
    """Whitespace tokens that are not listed (case matters), joined by one space."""
    tokens = F.split(squeeze(col), " ")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens, " ")


def replace_bold_unicode(col: Column) -> Column:
    """Mathematical bold and italic letters and digits become plain ones, r and s included."""
    return F.translate(col, STYLED, UNSTYLED)


@F.arrow_udf(T.StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One text at a time becomes a Python string; the parts of a batch are joined as Arrow data."""
    for texts in batches:
        parts, run, size = [], [], 0
        for text in texts:
            value = text.as_py()
            run.append(value if value is None else unicodedata.normalize("NFKC", value))
            size += len(value or "")
            if size >= RUN_CHARS:
                parts.append(pa.array(run, type=pa.string()))
                run, size = [], 0
        parts.append(pa.array(run, type=pa.string()))
        yield pa.concat_arrays(parts) if len(parts) > 1 else parts[0]


def std_string(col: Column, case: str | None = None) -> Column:
    """Trimmed, NFKC-normalised, squeezed text in the wanted case.

    Normalisation has no built-in function, so texts that it can change pass through Arrow batches; a text of ASCII is its own result.
    """
    own = F.octet_length(col) == F.char_length(col)
    plain = squeeze(F.trim(F.when(own, col).otherwise(_nfkc(F.when(~own, F.trim(col))))))
    return {None: lambda c: c, "lower": F.lower, "upper": F.upper}[case](plain)


def crop_strings(col: Column, start: int, end: int, ellipsis: str = "…") -> Column:
    """Characters ``start`` (included) to ``end`` (excluded), cut ends marked."""
    part = F.substring(col, start + 1, end - start)
    if start == 0:
        return F.when(F.length(col) > end, F.concat(part, F.lit(ellipsis))).otherwise(col)
    tail = F.when(F.length(col) > end - start, ellipsis).otherwise("")
    return F.concat(F.lit(ellipsis), part, tail)


def str_join(columns: Sequence[Column], delim: str) -> Column:
    """Joined text, null when any part is null."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.lit(delim)] * (i > 0) + [c.cast("string")]
    return F.concat(*parts)


def tokens(col: Column, accents: bool = False) -> Column:
    """Lower-case words of at least two word characters, accents removed unless kept."""
    low = F.lower(col) if accents else F.lower(strip_accents(col))
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


# Fixed patterns: insults with the letter swaps used to hide them.
LEXICON = (
    r"v[a4@]g[a4@]bund", r"s[a4@]f[a4@]d", r"\b(?:bosta|merda)\b", r"r[1i]d[1ií][kc]ul[a@o]", r"nojent", r"\bnojo\b",
    r"ladr[ãa@]o", r"ment[1i]ros[ao]", r"\b[ck](?:u|ool?)\b", r"canalha", r"bandid[ao]", r"\bburr[ao]|besta\b",
    r"piranha", r"carniça", r"lixo", r"p[@4a]lh[@4a][cç][a40@o]\b", r"m[@4a]l[@4a]ndr[ao40@]", r"est[uú]pid[oa]",
)


def lexicon_match(col: Column, patterns: Sequence[str] = LEXICON) -> Column:
    """True where any of the patterns occurs, whatever the case."""
    return col.rlike("(?iU)" + "|".join(patterns))


# Rows of the US and BR keyboards.
KEY_ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm,", "qwertyuiop'", "asdfghjklç", "zxcvbnm,")


def typo_neighbours(rows: Sequence[str] = KEY_ROWS) -> dict[str, str]:
    """For each key the keys that may be hit instead: itself and its horizontal neighbours."""
    near: dict[str, set[str]] = {}
    for row in rows:
        for i, key in enumerate(row):
            near.setdefault(key, set()).update(row[max(0, i - 1) : i + 2])
    return {k: "".join(sorted(v)) for k, v in near.items()}


def typo_pattern(term: str) -> str:
    """Regex of a whole term in which any letter may be a horizontal neighbour of the right key."""
    near = typo_neighbours()
    return "^" + "".join(f"[{near[c]}]" if c in near else f"[{c}]" for c in term.lower()) + "$"
