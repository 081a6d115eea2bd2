"""Curation: from all requirement rows of a job to the few that are formal, as a new state of versions.

Names are brought to one form, noise goes, the best row per name stays, groups stay whole with a minimum that shrinks with their members, and
units are taken greedily under two budgets: required ones first, then whatever is left as bonus.

The greedy walk needs few units: budgets only shrink, so once a unit of some cost doesn't fit, no later one of that cost does. Of each cost c
the first (required cap + formal cap) / c required units and the first formal cap / c others decide everything; row limits per (job, kind, cost) that Spark
applies before its shuffle leave some two hundred units of the busiest job, exactly. These are folded as one array.

Defined results: rows without skill or without a source among the evidence go; a kind that is neither required nor bonus counts as bonus; ties of names in
all scores go to the smaller skill; a job whose rows all go keeps no formal requirement, and all its open versions end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved, spread
from .gate import BLANKS, present, stripped
from .release import FORMAL_CAP, REQUIRED_CAP

#: Names that are no skills of their own, and other forms of names.
GENERIC = [
    "沟通能力", "沟通", "团队协作", "团队合作", "团队合作精神", "跨团队协作", "学习能力", "责任心", "抗压能力", "问题解决", "表达能力", "自我驱动",
    "编程习惯", "数学", "计算机", "算法", "computer science",
]
BRANDS = ["gpt", "gemini", "chatglm", "mixtral-7b", "llama2", "llama 2"]
BROAD = ["cv", "nlp", "计算机视觉", "自然语言处理"]
ALIASES = {"prompt engineering": "提示词工程", "promptengineering": "提示词工程", "提示词设计": "提示词工程", "llm application development": "大语言模型应用开发"}
#: What is done with a brand, by the words that tell.
BRAND_ACTIONS = {"API 集成": ["api", "接口", "调用"], "模型部署": ["部署", "上线", "推理服务"], "模型微调": ["微调", "fine-tune", "finetune"], "模型评测": ["评测", "评估", "benchmark"]}


def canonical(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """A name with single spaces, or what stands for it."""
    text = F.regexp_replace(stripped(name), f"{BLANKS}+", " ")
    out = text
    for folded, target in aliases.items():
        out = F.when(F.lower(text) == folded, F.lit(target)).otherwise(out)
    return out


def noise_kind(name: Column, generic: list[str] = GENERIC, brands: list[str] = BRANDS, broad: list[str] = BROAD) -> Column:
    folded = F.lower(name)
    return F.when(folded.isin(generic), "generic").when(folded.isin(brands), "brand").when(folded.isin(broad), "broad_domain").otherwise("skill")


def brand_action(name: Column, action: Column, context: Column, brands: list[str] = BRANDS) -> Column:
    """What skill a brand's mention stands for, by the words around it; null for all other names."""
    around = F.lower(F.concat_ws(" ", F.coalesce(action, F.lit("")), F.coalesce(context, F.lit(""))))
    out = F.lit(None).cast("string")
    for skill, words in reversed(BRAND_ACTIONS.items()):
        out = F.when(F.greatest(*(F.contains(around, F.lit(w)) for w in words)), F.lit(skill)).otherwise(out)
    return F.when(F.lower(stripped(name)).isin(brands), out)


def supported(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows with n_sources: how many of their sources are in evidence(job, id); rows without any go."""
    own = rows.withColumn("sources", present(F.col("sources")))
    found = own.select("job", "skill", F.explode("sources").alias("id")).distinct().join(evidence.select("job", "id").distinct(), ["job", "id"], "left_semi")
    return own.join(found.groupBy("job", "skill").agg(F.count("*").alias("n_sources")), ["job", "skill"])


def best_per_name(rows: DataFrame, aliases: dict[str, str], generic: list[str], brands: list[str], broad: list[str], tasks: int | None = None) -> DataFrame:
    named = rows.filter("skill is not null").withColumn("name", canonical(F.coalesce(F.col("name"), F.col("skill").cast("string")), aliases)).withColumn("noise", noise_kind(F.col("name"), generic, brands, broad))
    kept = named.filter("noise not in ('generic', 'brand')").withColumn("explicit", (F.coalesce("kind", F.lit("")) == "required").cast("int")).withColumn("narrow", (F.col("noise") != "broad_domain").cast("int"))
    kept = kept.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)).cast("double"))
    order = Window.partitionBy("job", "name").orderBy(F.desc("n_sources"), F.desc("explicit"), F.desc("narrow"), F.desc("confidence"), "skill")
    return spread(kept, tasks, "job", "name").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def members_and_units(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their unit, and the units (job, unit, wants, cost, score) that are taken or left as a whole."""
    group = F.nullif("group_id", F.lit(""))
    members = best.withColumn("unit", F.when(group.isNotNull(), F.concat(F.lit("g:"), group)).otherwise(F.concat(F.lit("s:"), F.col("skill").cast("string"))))
    members = members.withColumn("score", F.struct("n_sources", "explicit", "narrow", "confidence", F.lower("name").alias("folded"), "skill"))
    least = F.coalesce(F.nullif(F.max_by("min_required", "score"), F.lit(0)), F.lit(1))
    rows = members.groupBy("job", "unit").agg(F.max("score").alias("score"), F.max("explicit").alias("wants"), F.count("*").alias("size"), least.alias("least"))
    cost = F.when(F.col("size") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("least"), F.col("size")))).cast("int")
    return members, rows.withColumn("cost", cost)


def greedy(units: DataFrame, required_cap: int = REQUIRED_CAP, formal_cap: int = FORMAL_CAP) -> DataFrame:
    """job, unit, taken_as of the units(job, unit, wants, cost, score) that both budgets let in, by falling score."""
    rows = units.filter(F.col("cost") <= formal_cap).select("job", "unit", "wants", "cost", "score")
    nth = F.row_number().over(Window.partitionBy("job", "wants", "cost").orderBy(F.desc("score")))
    most = F.floor(F.when(F.col("wants") == 1, required_cap + formal_cap).otherwise(formal_cap) / F.col("cost"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= required_cap + formal_cap).filter(F.col("nth") <= most)
    lists = few.groupBy("job").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "unit", "wants", "cost")))).alias("units"))
    nothing = F.array().cast("array<string>")

    def walk(units: Column, budget: Column) -> Column:
        start = F.struct(budget.cast("int").alias("left"), nothing.alias("taken"))
        step = lambda a, u: F.when(u["cost"] <= a["left"], F.struct((a["left"] - u["cost"]).alias("left"), F.concat(a["taken"], F.array(u["unit"])).alias("taken"))).otherwise(a)
        return F.aggregate(units, start, step)

    first = lists.withColumn("required", walk(F.filter("units", lambda u: u["wants"] == 1), F.lit(required_cap)))
    second = first.withColumn("bonus", walk(F.filter("units", lambda u: ~F.array_contains(F.col("required.taken"), u["unit"])), F.greatest(F.lit(0), F.lit(formal_cap - required_cap) + F.col("required.left"))))
    part = lambda c: second.select("job", F.explode(f"{c}.taken").alias("unit"), F.lit(c).alias("taken_as"))
    return part("required").unionByName(part("bonus"))


def formal_requirements(
    rows: DataFrame, evidence: DataFrame | None, *, required_cap: int = REQUIRED_CAP, formal_cap: int = FORMAL_CAP,
    aliases: dict[str, str] = ALIASES, generic: list[str] = GENERIC, brands: list[str] = BRANDS, broad: list[str] = BROAD, tasks: int | None = None,
) -> DataFrame:
    """job, skill, name, kind, group_id, min_required, n_sources, confidence of the rows(job, skill, name, kind, group_id, min_required, confidence, sources) that stay formal.

    Rows whose sources are counted already bring n_sources instead, with None as evidence. The best row per name is written once; all else reads it."""
    counted = rows.filter("n_sources > 0") if evidence is None else supported(rows, evidence)
    best = best_per_name(counted, aliases, generic, brands, broad, tasks).select("job", "skill", "name", "group_id", "min_required", "confidence", "n_sources", "explicit", "narrow")
    members, of_units = members_and_units(saved(best, "best-per-name"))
    chosen = of_units.join(greedy(of_units, required_cap, formal_cap), ["job", "unit"]).select("job", "unit", "size", "cost", "taken_as")
    alone = F.col("size") == 1
    return members.join(chosen, ["job", "unit"]).select(
        "job", "skill", "name", F.col("taken_as").alias("kind"), F.when(~alone, F.col("group_id")).alias("group_id"), F.when(~alone & F.col("group_id").isNotNull(), F.col("cost")).alias("min_required"), "n_sources", "confidence"
    )


BUSINESS = ["kind", "group_id", "min_required"]


def next_state(current: DataFrame, selected: DataFrame, at: DataFrame) -> DataFrame:
    """All versions after curation: current(job, skill, BUSINESS, valid_from, valid_to) with selected(job, skill, BUSINESS) in force from at(job, at) on. change: past, kept,
    replaced (another version opens), expired, opened. The same selection once more changes nothing."""
    past = current.filter("valid_to is not null").withColumn("change", F.lit("past"))
    left = current.filter("valid_to is null").select("job", "skill", F.struct(*BUSINESS).alias("old"), "valid_from")
    right = selected.select("job", "skill", F.struct(*BUSINESS).alias("new"))
    both = left.join(right, ["job", "skill"], "full").join(at.select("job", "at"), "job", "left")
    was, is_ = F.col("valid_from").isNotNull(), F.col("new").isNotNull()
    same = was & is_ & F.col("old").eqNullSafe(F.col("new"))
    change = F.when(same, "kept").when(is_, "replaced").otherwise("expired")
    old = both.filter(was).select("job", "skill", "old.*", "valid_from", F.when(~same, F.greatest("valid_from", "at")).alias("valid_to"), change.alias("change"))
    new = both.filter(is_ & ~same).select("job", "skill", "new.*", F.greatest("valid_from", "at").alias("valid_from"), F.lit(None).cast(dict(current.dtypes)["valid_to"]).alias("valid_to"), F.lit("opened").alias("change"))
    return past.select(*old.columns).unionByName(old).unionByName(new)
