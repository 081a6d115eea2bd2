"""Column expressions on posting and profile texts. Word lists are parameters; the defaults are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of companies, channel names that are no source, heads of sections, marks of evidence.
SUFFIXES = ["股份有限公司", "有限责任公司", "有限公司", "股份公司", "股份"]
CHANNELS = ["ats", "greenhouse", "lever", "ashby"]
SECTION_HEADS = {
    "benefit": ["薪酬福利", "福利待遇", "岗位福利", "福利"],
    "intro": ["公司介绍", "关于我们", "公司简介"],
    "duty": ["岗位职责", "工作职责", "职责描述", "职责"],
    "requirement": ["任职资格", "任职要求", "岗位要求", "要求"],
}
RESULT_VERBS = "负责|主导|交付|实现|提升|降低|下降|降至|压缩|built|led|delivered|improv|reduc"
USE_VERBS = "负责|使用|开发|构建|维护|实现|参与|used|built|develop|worked"
SENTENCE_END = r"[\n。！!]+|(?<!\d)\.(?!\d)"


def squash(c: Column) -> Column:
    """Without white space of any kind, that of ideographic texts too."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x1C-\x1F\x85\p{Z}]+", "")


def strip_html(c: Column) -> Column:
    """Tags become spaces, runs of spaces one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " "), r"\s+", " "))


def normalise_company(c: Column) -> Column:
    """Without brackets, white space and legal suffixes, of which any number may end the name; never empty by a suffix."""
    bare = squash(F.regexp_replace(c, r"[（(][^）)]*[）)]", ""))
    return F.regexp_replace(bare, f"^(.+?)({'|'.join(SUFFIXES)})+$", "$1")


def is_channel(c: Column) -> Column:
    return F.lower(squash(c)).isin(CHANNELS)


def fingerprint(source: Column, job_id: Column, company: Column, title: Column, city: Column) -> Column:
    known = F.coalesce(job_id, F.lit("")) != ""
    return F.sha2(F.when(known, F.concat(source, job_id)).otherwise(F.concat_ws("|", normalise_company(company), squash(title), squash(city))), 256)


def parse_day(c: Column, year: Column | None = None) -> Column:
    """The timestamp in a text: four formats at its start, then the first date in it, then month and day before a mark with a given year."""
    text = F.trim(F.coalesce(c, F.lit("")))

    def formats(x: Column) -> Column:
        return F.coalesce(F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), *[F.try_to_timestamp(F.substring(x, 1, 10), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")])

    inner = formats(F.regexp_extract(text, r"(\d{4}[-/.]\d{2}[-/.]\d{2})", 1))
    found = F.coalesce(formats(text), inner)
    if year is None:
        return found
    month, day = (F.regexp_extract(text, r"(?<!\d)(\d{1,2})-(\d{1,2})发布", k) for k in (1, 2))
    return F.coalesce(found, F.try_to_timestamp(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))


def sections(body: Column, heads: dict[str, list[str]] = SECTION_HEADS) -> Column:
    """Array of (section, text) in order of place. Per section the first listed head that occurs marks it; what stands before the first mark, or
    a text without any, is requirement."""
    text = F.coalesce(body, F.lit(""))
    marks = []
    for name, words in heads.items():
        at = F.coalesce(*[F.nullif(F.locate(w, text), F.lit(0)) for w in words])
        marks.append(F.struct(at.alias("at"), F.lit(name).alias("section")))
    hits = F.array_sort(F.filter(F.array(*marks), lambda m: m["at"].isNotNull()))
    first = F.try_element_at(hits, F.lit(1))["at"]
    lead = F.when(first.isNull(), F.array(F.struct(F.lit(1).alias("at"), F.lit("requirement").alias("section")))).when(first > 1, F.array(F.struct(F.lit(1).alias("at"), F.lit("requirement").alias("section")))).otherwise(F.array().cast("array<struct<at:int,section:string>>"))
    every = F.concat(lead, hits)
    ends = lambda i: F.coalesce(F.try_element_at(every, i + 2)["at"], F.length(text) + 1)
    return F.transform(every, lambda m, i: F.struct(m["section"].alias("section"), F.substring(text, m["at"], ends(i) - m["at"]).alias("text")))


def classify(title: Column, keywords: list[tuple[str, str]], default: str | None = None) -> Column:
    """The domain of the first keyword in order of priority. ASCII keywords up to three characters need word bounds."""
    out = F.lit(default)
    low = F.lower(title)
    for word, domain in reversed(keywords):
        short = word.isascii() and len(word) <= 3
        hit = low.rlike(rf"(?<![a-z0-9]){word.lower()}(?![a-z0-9])") if short else F.contains(low, F.lit(word.lower()))
        out = F.when(hit, domain).otherwise(out)
    return out


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def evidence_level(sentence: Column, result: str = RESULT_VERBS, use: str = USE_VERBS) -> Column:
    """What a sentence shows: a result (a number and a verb of delivery), use, or a mention."""
    number = sentence.rlike(r"(?i)\d+(?:\.\d+)?\s*(?:%|ms|秒|万|qps|次)?")
    return F.when(number & sentence.rlike(f"(?i){result}"), "result").when(sentence.rlike(f"(?i){use}"), "use").otherwise("mention")


def mask_personal(c: Column) -> Column:
    """E-mail addresses and mobile numbers replaced."""
    return F.regexp_replace(F.regexp_replace(c, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[email]"), r"(?<!\d)1[3-9]\d{9}(?!\d)", "[phone]")


def month_ranges(c: Column) -> Column:
    """Array of (text, first, last) month numbers of date ranges."""
    pattern = r"(20\d{2})[./-](\d{1,2}).{0,3}(20\d{2})[./-](\d{1,2})"
    each = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    part = lambda t, k: F.regexp_extract(t, pattern, k).cast("int")
    return F.transform(each, lambda t: F.struct(t.alias("text"), (part(t, 1) * 12 + part(t, 2)).alias("first"), (part(t, 3) * 12 + part(t, 4)).alias("last")))


def simhash_tokens(c: Column) -> Column:
    """Lower-case ASCII words, and pairs of neighbouring ideographs (a lone one is itself)."""
    text = F.coalesce(c, F.lit(""))
    signs = F.regexp_extract_all(text, F.lit(r"([一-鿿])"), F.lit(1))
    pairs = F.when(F.size(signs) < 2, signs).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(signs) - 1, F.lit(1))), lambda i: F.concat(F.try_element_at(signs, i), F.coalesce(F.try_element_at(signs, i + 1), F.lit("")))))
    return F.concat(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), lambda t: F.lower(t)), pairs)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ngram_vector(c: Column, buckets: int = 64) -> Column:
    """Counts of padded character trigrams in hash buckets."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.pmod(F.conv(F.substring(F.md5(F.substring(text, i, F.lit(3))), 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
