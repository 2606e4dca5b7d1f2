"""Encodings of bytes, and texts that were decoded with the wrong one. Arrow batches, Python's codecs, numpy for the counting."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that go to Python at once; a worker holds them several times over, as bytes, texts and results.
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
HEAD, TAIL = 64 * 1024, 16 * 1024
CODECS = {"UTF-8": "utf-8", "UTF-8 BOM": "utf-8-sig", "GBK": "gbk", "GB18030": "gb18030", "BIG5": "big5", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}
#: In order of preference among those that give the same text.
POOL = ["GBK", "GB18030", "BIG5", "UTF-16LE", "UTF-16BE"]
BOMS = [(b"\xef\xbb\xbf", "UTF-8 BOM"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]
SURE, DIRTY = 0.75, 0.02
#: The default of `familiar`: characters of which half and more of running Chinese consists, in both scripts. Another table can be given instead.
FREQUENT = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日这個們來為國說時會對於著過發後裡經麼學當沒動還進樣開從實書見長頭間樹問聽話讓給誰風門車東馬"

DETECTED = "encoding string, confidence double, confident boolean, candidates array<struct<encoding: string, score: double, confidence: double, bad_ratio: double, familiar_ratio: double>>"
RECOVERED = "text string, chain string, applied boolean, improved double, unrecoverable boolean, partial boolean"


@dataclass
class Score:
    """How much a text looks like Chinese prose: the total, and the shares of broken and Chinese characters, and of frequent ones among these."""

    total: float
    bad: float
    cjk: float
    familiar: float


def small_batches() -> None:
    """Bounds this session's Arrow batches by BATCH_BYTES, unless it has a bound of its own: by rows alone, ten thousand texts of any length are one batch."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


@functools.lru_cache(8)
def _codes(familiar: str) -> np.ndarray:
    return np.unique(np.frombuffer(familiar.encode("utf-32-le"), np.uint32))


def score(text: str, familiar: str = FREQUENT) -> Score:
    if not text:
        return Score(-50.0, 1.0, 0.0, 0.0)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    broken = (c == 0xFFFD) | ((c < 0x20) & ~np.isin(c, (9, 10, 13))) | ((c >= 0xE000) & (c <= 0xF8FF))
    hanzi, marks = (c >= 0x4E00) & (c <= 0x9FFF), (c >= 0x3000) & (c <= 0x303F)
    n, bad, cjk = len(c), int(broken.sum()), int(hanzi.sum() + marks.sum())
    known = int(np.isin(c[hanzi], _codes(familiar)).sum()) / cjk if cjk else 0.0
    share = cjk / n
    return Score((n - bad) / n * 40 + share * 25 + known * 35 * (share > 0.02) - bad / n * 120, bad / n, share, known)


def confidence(best: Score, second: Score | None, n: int) -> float:
    """0.5 to 0.97 by the distance to the second; dirty seconds are no rivals, a dirty best is never sure, a sole clean one nearly always."""
    gap = best.total - (second.total if second else best.total - 30)
    sure = 0.5 + min(gap, 30) / 30 * 0.47
    if second and second.bad > DIRTY:
        sure = min(0.97, sure + 0.08)
    if best.bad > DIRTY:
        sure = min(sure, 0.45)
    elif n == 1:
        sure = max(sure, 0.9)
    return round(sure, 3)


def detect_one(data: bytes | None, familiar: str = FREQUENT) -> tuple:
    """The encoding of bytes: by mark, then as valid UTF-8, then the best looking of the pool (by head and tail)."""
    if not data:
        return ("UTF-8", 0.0, False, [])
    for mark, name in BOMS:
        if data.startswith(mark):
            return (name, 0.99, True, [(name, 100.0, 0.99, 0.0, 0.0)])
    try:
        data.decode("utf-8")
        return ("UTF-8", 0.98, True, [("UTF-8", 100.0, 0.98, 0.0, 0.0)])
    except UnicodeDecodeError:
        pass
    sample = data if len(data) <= HEAD + TAIL else data[:HEAD] + data[-TAIL:]
    decoded: dict[str, str] = {}
    second = vote(sample)
    for name in [*POOL, *([second[0]] if second else [])]:
        decoded.setdefault(sample.decode(CODECS[name], "replace"), name)
    scored = sorted(((score(text, familiar), name) for text, name in decoded.items()), key=lambda x: -x[0].total)
    sure = confidence(scored[0][0], scored[1][0] if len(scored) > 1 else None, len(scored))
    if second and second[0] == scored[0][1] and scored[0][0].bad <= DIRTY:
        # two that look at other things and say the same
        sure = max(sure, round(0.5 + 0.47 * second[1], 3))
    candidates = [(name, round(s.total, 1), sure if i == 0 else max(0.0, round(sure - i * 0.2, 3)), round(s.bad, 4), round(s.familiar, 3)) for i, (s, name) in enumerate(scored)]
    return (scored[0][1], sure, sure >= SURE, candidates)


def _certain(data: Column) -> Column:
    """What detect gives for bytes that need no guess, in the JVM: none, those with a mark, and valid UTF-8. Null for others."""

    def found(name: str, sure: float, candidates: bool = True) -> Column:
        one = F.struct(F.lit(name).alias("encoding"), F.lit(100.0).alias("score"), F.lit(sure).alias("confidence"), F.lit(0.0).alias("bad_ratio"), F.lit(0.0).alias("familiar_ratio"))
        listed = F.array(one) if candidates else F.array().cast("array<struct<encoding: string, score: double, confidence: double, bad_ratio: double, familiar_ratio: double>>")
        return F.struct(F.lit(name).alias("encoding"), F.lit(sure).alias("confidence"), F.lit(sure >= SURE).alias("confident"), listed.alias("candidates"))

    out = F.when(data.isNull() | (F.octet_length(data) == 0), found("UTF-8", 0.0, False))
    for mark, name in BOMS:
        out = out.when(F.startswith(data, F.lit(mark)), found(name, 0.99))
    return out.when(F.is_valid_utf8(data.cast("string")), found("UTF-8", 0.98))


def detect(data: Column, familiar: str = FREQUENT) -> Column:
    """detect_one of each row's bytes; only bytes that need a guess leave the JVM."""

    @F.pandas_udf(DETECTED)
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect_one(bytes(x) if x is not None else None, familiar) for x in batch], columns=["encoding", "confidence", "confident", "candidates"])

    small_batches()
    certain = _certain(data)
    return F.coalesce(certain, run(F.when(certain.isNull(), data)))


def decode(data: Column, encoding: Column) -> Column:
    """Bytes as text by the name of their encoding; what cannot be read becomes U+FFFD, an unknown name null. Valid UTF-8 is read in the JVM."""

    @F.pandas_udf("string")
    def run(batch: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([bytes(x).decode(CODECS[n], "replace").removeprefix("﻿") if x is not None and n in CODECS else None for x, n in zip(batch, names)], dtype=object)

    small_batches()
    text = data.cast("string")
    plain = (encoding == "UTF-8") & F.is_valid_utf8(text)
    read = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.coalesce(F.when(plain, read), run(F.when(~F.coalesce(plain, F.lit(False)), data), encoding))


# A second opinion, by the bytes alone ------------------------------------------------------------------------------------------------------------

#: Encodings of one or two bytes: what a character of two bytes looks like, and the first bytes of the more frequent half of their characters, in whose order the standards put them.
TWO_BYTES = {"GBK": (rb"[\xa1-\xf7][\xa1-\xfe]", 0xB0, 0xD7), "BIG5": (rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", 0xA4, 0xC6)}
_TAKEN = {name: re.compile(rb"[\x00-\x7f]+|((?:" + pair + rb")+)|(.)", re.S) for name, (pair, _, _) in TWO_BYTES.items()}
_UTF8 = re.compile(rb"[\x00-\x7f]+|((?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+)|(.)", re.S)
#: Broken characters in a hundred over which an encoding is out; characters below which there is no opinion.
BROKEN, LEAST_PAIRS = 2, 4


def vote(data: bytes | None) -> tuple[str, float] | None:
    """The encoding that the bytes' characters are put together and spread as, and how sure that is (0 to 1); None for bytes that are like none, or hardly any.

    Bytes are divided into characters as each encoding does. Where few are broken, the share of frequent ones counts: in prose nearly all are, and in bytes of another
    encoding as many as chance has.
    """
    data = (data or b"")[: HEAD + TAIL]
    found: list[tuple[float, str]] = []

    def taken(pattern: re.Pattern) -> tuple[bytes, int]:
        whole, broken = [], 0
        for m in pattern.finditer(data):
            if m[1]:
                whole.append(m[1])
            elif m[2]:
                broken += 1
        return b"".join(whole), broken

    whole, broken = taken(_UTF8)
    characters = sum(b >= 0xC0 for b in whole)
    if characters >= LEAST_PAIRS and 100 * broken <= BROKEN * characters:
        found.append((1.0 - broken / (characters + broken), "UTF-8"))
    for name, (_, low, high) in TWO_BYTES.items():
        whole, broken = taken(_TAKEN[name])
        leads = np.frombuffer(whole, np.uint8)[::2]
        if len(leads) >= LEAST_PAIRS and 100 * broken <= BROKEN * len(leads):
            marks = leads < (0xA4 if name == "BIG5" else 0xB0)
            n = int((~marks).sum())
            share = float(((leads >= low) & (leads <= high)).sum()) / n if n else 0.0
            found.append((share * (1 - broken / (len(leads) + broken)) * 0.99, name))
    if not found:
        return None
    sure, name = max(found)
    return (name, round(sure, 3)) if sure > 0.5 else None


def voted(data: Column) -> Column:
    """vote of each row's bytes, as encoding and confidence; null for none."""

    @F.pandas_udf("encoding string, confidence double")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vote(bytes(x)) or (None, None) if x is not None else (None, None) for x in batch], columns=["encoding", "confidence"])

    small_batches()
    out = run(data)
    return F.when(out["encoding"].isNotNull(), out)


def familiar_of(texts: DataFrame, column: str = "text", most: int = 800, kind: str = "[\\u4e00-\\u9fff]") -> DataFrame:
    """The `most` commonest characters of a kind in texts, with n, the commonest first (ties by code point): a table of familiar characters learned from texts that are read rightly.

    Characters are counted in each text before they are exchanged, so a frequent one is a row a task and no hot key.
    """
    chars = texts.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(kind), F.lit(0))).alias("char"))
    return chars.groupBy("char").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.encode("char", "UTF-8")).limit(most)


#: Wrong decodings and how they are undone: written back to bytes by the first, read by the second.
CHAINS = {
    "latin1→utf8": ("latin-1", "utf-8"), "gbk→utf8": ("gbk", "utf-8"), "big5→utf8": ("big5", "utf-8"), "utf8→gbk": ("utf-8", "gbk"), "latin1→gbk": ("latin-1", "gbk"), "utf8→big5": ("utf-8", "big5"),
}

# Signs of wrong decoding and how they are called.
LOST = "锟斤拷"
SIGNS = [
    (LOST, "出现了「锟斤拷」"),
    ("\\ufffd", "出现了无法解码的替换字符"),
    ("(?:[\\u00C0-\\u00FF][\\u0080-\\u00BF]){2,}", "大片西欧扩展字符，像是 UTF-8 被当成西欧编码读了"),
    ("(?:[\\u00A1-\\u00FF]{4,})", "连续出现西欧字符"),
    ("[\\uE000-\\uF8FF]{2,}", "出现了私用区字符"),
]
FATAL_COUNT, FATAL_SHARE = 3, 0.002


def inspect(text: Column) -> Column:
    """signs (labels), n_lost (replacement characters), mojibake, and fatal: so many characters are gone that nothing brings the text back."""
    lost = F.regexp_count(text, F.lit("\\ufffd"))
    signs = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in SIGNS]))
    fatal = (lost >= FATAL_COUNT) | (lost / F.greatest(F.length(text), F.lit(1)) > FATAL_SHARE) | F.contains(text, F.lit(LOST))
    return F.struct(signs.alias("signs"), lost.alias("n_lost"), (F.size(signs) > 0).alias("mojibake"), fatal.alias("fatal"))


def recover_one(text: str | None, familiar: str = FREQUENT) -> tuple:
    text = text or ""
    before, tried = score(text, familiar), []
    for name, (back, forth) in CHAINS.items():
        if back == "latin-1":
            # as bytes are taken from characters there: the low eight bits of each UTF-16 unit
            raw = text.encode("utf-16-le", "surrogatepass")[::2]
        else:
            raw = text.encode(back, "replace")
        out = raw.decode(forth, "replace")
        tried.append((score(out, familiar), name, out))
    tried.sort(key=lambda x: -x[0].total)
    clean = [x for x in tried if x[0].bad < 0.01 and x[0].familiar > 0.2]
    improved = clean[0][0].total - before.total if clean else 0.0
    applied = bool(clean) and improved > 3
    lost = text.count("�")
    fatal = lost >= FATAL_COUNT or lost / max(1, len(text)) > FATAL_SHARE or LOST in text
    partial = not applied and not fatal and any(s.total - before.total > 3 for s, _, _ in tried)
    return (clean[0][2] if applied else text, clean[0][1] if applied else "", applied, round(improved, 1), fatal, partial)


def recover(text: Column, familiar: str = FREQUENT) -> Column:
    """A text read back through the chain that makes it the best clean Chinese, if that is clearly better than it is."""

    @F.pandas_udf(RECOVERED)
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([recover_one(x, familiar) for x in batch], columns=["text", "chain", "applied", "improved", "unrecoverable", "partial"])

    small_batches()
    return run(text)


def zero_parity(data: Column) -> Column:
    """UTF-16LE or UTF-16BE where over 30 % of every other byte of the first 4096 is zero; else null. In the JVM, on hexadecimal digits."""
    digits = F.hex(F.substring(data, 1, 4096))
    pairs = F.regexp_extract_all(digits, F.lit("...."), F.lit(0))
    share = lambda pattern: F.size(F.filter(pairs, lambda x: x.rlike(pattern))) / F.size(pairs)
    return F.when(F.length(digits) >= 32, F.when(share("^..00$") > 0.3, "UTF-16LE").when(share("^00..$") > 0.3, "UTF-16BE"))


def text_scores(text: Column, familiar: str = FREQUENT) -> Column:
    """score's measures as a column, without Python: shares of broken and Chinese characters, and of frequent ones."""
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda chars: F.regexp_count(text, F.lit(chars))
    bad = count("[\\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ue000-\\uf8ff]")
    cjk = count("[\\u4e00-\\u9fff\\u3000-\\u303f]")
    known = F.when(cjk > 0, count(f"[{''.join(dict.fromkeys(familiar))}]") / cjk).otherwise(0.0)
    share = cjk / n
    total = F.when(F.length(text) > 0, (n - bad) / n * 40 + share * 25 + F.when(share > 0.02, known * 35).otherwise(0.0) - bad / n * 120).otherwise(-50.0)
    return F.struct(total.alias("score"), (bad / n).alias("bad_ratio"), share.alias("cjk_ratio"), known.alias("familiar_ratio"))


def guessed(text: Column, familiar: str = FREQUENT) -> Column:
    """What a text that was decoded wrongly may have been encoded in, by its looks alone: at most three names, the likeliest first."""
    found = text_scores(text, familiar)
    cjk, known = found["cjk_ratio"], found["familiar_ratio"]
    utf8 = F.contains(text, F.lit(LOST)) | text.rlike(SIGNS[2][0])
    odd = (cjk > 0.3) & (known < 0.15)
    names = F.array_compact(F.array(F.when(utf8 | odd, F.lit("UTF-8")), F.when(odd | ((cjk > 0.5) & (known >= 0.15)), F.lit("GBK")), F.when(text.rlike(SIGNS[1][0]), F.lit("GB18030"))))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("UTF-8"), F.lit("GBK")))


def candidates(detected: Column, text: Column, most: int = 3) -> Column:
    """Encodings for a text that could not be recovered: those that its bytes gave (detect's candidates; null without bytes), then those by its looks, each once."""
    names = F.coalesce(F.transform(detected["candidates"], lambda c: c["encoding"]), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(names, guessed(text))), 1, most)
