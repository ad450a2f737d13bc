"""Platforms and account names found in free-form links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: one per platform, matched anywhere and without case.
PLATFORMS = {
    "facebook": r"f[aeo]i?z?c+e{1,2}o? ?[cb]{1,2}[ou]{1,}c?k?|\bfc?bk?\b|\bface\b|fa[sc]?bo+k+|faceook|fca?ebook",
    "twitter": r"t[uw]{1,}[ei]{1,}t{1,}w?e{1,}r?|tweet",
    "instagram": r"[ei][mn]?a?sa?t[sr]?a?[nr]?[qg][rl]e?[am][mn]?|\binsta?\b|(?!instala[cç][aã]o|instala[çc][õo]es|intant[âa]ne[ao]|instabio\.cc)insta|in?s?tragr?[ea][nm]?|is?na?tagra[nm]?",
    "tiktok": r"tit?[ck][\- ]?to[kc]",
    "youtube": r"y[ou]{1,} ?t[uo]be?|voutube|\byoutu\.be\b",
    "linkedin": r"lin?k[ie]?n?d[ \-]?ie?n|linked",
    "soundcloud": r"soundcloud",
    "snapchat": r"snape?[ \-]?chat",
    "spotify": r"spoti?fy",
    "whatsapp": r"wh?as?t+h?[ \-]?[sz]+[ \-]?a+p+|whats|watshapp|zap[ \-:\(\)]+\d+|\d+[ \-:\(\)]+zap|\bwa+p*\.me\b|contate\.me",
    "telegram": r"tele?gra[nm]|\bt\.me\b",
    "signal": r"signal",
    "parler": r"par\.pw|parler?",
    "badoo": r"badoo",
    "tinder": r"tinder",
    "flickr": r"flicke?r",
    "grindr": r"grindr",
    "kwai": r"\bkw\.?ai\b",
    "twitch": r"twitch",
    "skoob": r"\bskoob\b",
    "blogspot": r"blog?spot\b",
    "wordpress": r"wordpress",
    "wix": r"wix",
    "democratize": r"financie\.de",
    "votolegal": r"votolegal",
    "drive": r"drive\.go",
    "anchor": r"anchor",
    "linktree": r"link(?:tr)?\.ee[/.@?]",
    "essentjus": r"essentjus",
    "pinterest": r"pinterest|pin\.it",
    "messenger": r"mes+enger|m\.me/",
    "lkt": r"lkt(?:3\.com|\.bio)",
    "tse": r"tse\.jus\.br",
    "castbox": r"castbox\.fm",
    "issuu": r"issuu",
    "campanhadobem": r"campanhadobem",
    "campsite": r"campsite",
    "biolinky": r"biolinky",
    "skype": r"\bsk[iy]pe\b",
    "lattes": r"\blattes\b",
    "flow.page": r"flow\.page",
    "medium": r"medium\.com",
    "apoia.org": r"apoia\.org",
    "deezer": r"deezer",
    "bit.ly": r"bit\.ly",
    "tumblr": r"tumblr",
    "periscope": r"pscp\.tv",
    "queroapoiar": r"queroapoiar",
    "cutt.ly": r"cutt\.ly",
    "telefone": r"^[+\d\(\)\- ]{8,}$",
    "patriabook": r"patriabook",
    "abre.bio": r"abre\.bio",
    "gettr": r"gettr",
    "beacons": r"beacons.ai",
    "vaquinhaeleitoral": r"vaquinhaeleitoral.com.br",
    "linklist": r"linklist.bio",
    "nenhuma": r"n[aã]o (?:tem|possui)|nenhum",
    "email": r"[\w\-\.]+@+(?:[\w\-]+[\.,])+[\w\-]{2,6}|^email|e[ -]mail",
}
WEBSITE = r"ht{1,2}p{1,2}s?:/{0,3}(?:www\.)?(?:[\w\-]+\.)+[\w\-]{2,6}|www\.(?:[\w\-]+\.)+[\w\-]{2,6}|\.(?:com|org|net)$|\.(?:com|art)\.br"
HANDLE = r"^@|[ \-:/]@"

# Fixed patterns: account names, with the misspellings of the host that occur.
TWITTER_SIMPLE = r"(?U)(?:[Tt]wit+er\.com(?:\.br)?/@?|@)(\w+)"
TWITTER_FULL = r"(?iU)(?:(?:t[uw]{1,}[ei]{1,}t{1,}w?e{1,}r?|tweet)\.com(?:\.br)?/+[@:]?|@)(\w+)"
TWITTER_REPAIRS = (
    (r"https?:/+(?:www\.)?twitter\.com/https?:/*", "https://"),
    (r"https?:/+(?:www\.)?twitter\.com/www.twitter.com*", "https://www.twitter.com"),
    (r"www\.twitter/", "www.twitter.com/"),
)
INSTAGRAM = (
    r"(?iu)(?:[ei][mn]?a?sa?t[sr]?a?[nr]?[qg][rl]e?[am][mn]?|in?s?tragr?[ea][nm]?|is?na?tagra[nm]?|instar?[gr]am)"
    r"(?:.com)?/?:?@?([a-zA-Z0-9\._]{1,30})"
)
INSTAGRAM_REPAIRS = (
    (r"https?:/+(?:www\.)?instagram\.com/https?:/*", "https://"),
    (r"/accounts/login/\?next=/", "/"),
    (r"/accounts/", "/"),
    (r"(?i)/stories/", "/"),
)
VALID_USERNAME = r"^[A-Za-z0-9_]{1,15}$"


def _extract(col: Column, repairs: Sequence[tuple[str, str]], pattern: str, lower: bool) -> Column:
    for old, new in repairs:
        col = F.regexp_replace(col, old, new)
    found = F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))
    return F.lower(found) if lower else found


def twitter_username(col: Column, lower: bool = True, repair: bool = True) -> Column:
    """Account name in a link or handle, null when there is none.

    ``repair`` first mends doubled hosts; without it the stricter host spelling applies.
    """
    if repair:
        return _extract(col, TWITTER_REPAIRS, TWITTER_FULL, lower)
    return _extract(col, (), TWITTER_SIMPLE, lower)


def instagram_username(col: Column, lower: bool = True) -> Column:
    return _extract(col, INSTAGRAM_REPAIRS, INSTAGRAM, lower)


def valid_username(col: Column) -> Column:
    return col.rlike(VALID_USERNAME)


def platform_flags(url: Column, patterns: Mapping[str, str] = PLATFORMS) -> list[Column]:
    """0/1 columns for every platform, then ``website``, ``arroba`` and ``usuario``.

    The last three apply in that order and only to links no earlier column claimed.
    """
    text = F.trim(url)
    hit = {name: text.rlike(f"(?iU){regex}") for name, regex in patterns.items()}
    known = F.lit(False)
    for h in hit.values():
        known = known | h
    site = text.rlike(f"(?iU){WEBSITE}")
    handle = text.rlike(f"(?iU){HANDLE}")
    rest = F.when(known, "").when(site, "website").when(handle, "arroba").otherwise("usuario")
    out = [h.cast("int").alias(name) for name, h in hit.items()]
    return out + [(rest == name).cast("int").alias(name) for name in ("website", "arroba", "usuario")]
