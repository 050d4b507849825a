"""Making evaluation questions: context chosen by the graph, questions that name something, items told apart.

The model that writes a question is the caller's; what goes in and what is kept of its answers is decided here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators import graph_query
from lodeseek.plans.staging import discard, stage

# Words of places and of times, and characters of surnames; a question with one of them, or with a digit, is specific.
PLACES = ["路", "号", "室", "村", "镇", "区", "市", "县", "街", "楼", "栋", "单元", "层"]
TIMES = ["年", "月", "日", "时", "分", "点"]
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张"
    "孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎"
    "鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤"
    "滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟黄"
    "穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞"
    "熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭"
    "梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯"
)
SPECIFIC = rf"[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨{SURNAMES}]|{'|'.join(PLACES + TIMES)}"
DECAY = 0.9


def specific(question: Column) -> Column:
    """Whether a question names a number, place, time or person; null and blank ones don't."""
    return F.coalesce(question, F.lit("")).rlike(SPECIFIC)


def squashed(question: Column) -> Column:
    """What two questions are compared by: no white space, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(question, F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]+", ""))


def told_apart(items: DataFrame, count: int | None = None) -> DataFrame:
    """Items (attempt, query, gold_chunk_ids) of which none before that is kept has the question or the gold set; the first ``count``.

    An item that is first of its question and of its set stays, those that meet one that stays go, and so on with the rest:
    the rows that going through the items in order would keep, with few rounds and no item paired with another.
    """
    gold = F.array_sort(F.array_distinct(F.transform(F.coalesce("gold_chunk_ids", F.array()), lambda x: x.cast("string"))))
    left = stage(items.withColumns({"_q": squashed(F.col("query")), "_g": gold}).filter("_q <> ''"), "items")
    kept = None
    while left.limit(1).count():
        first = left.withColumns({f"_f{c}": F.min("attempt").over(Window.partitionBy(c)) for c in ("_q", "_g")}).filter("attempt = _f_q AND attempt = _f_g").drop("_f_q", "_f_g")
        first = stage(first, "items-first")
        kept = first if kept is None else kept.unionByName(first)
        rest = stage(left.join(first.select("_q"), "_q", "left_anti").join(first.select("_g"), "_g", "left_anti").select(*left.columns), "items")
        discard(left)
        left = rest
    out = left if kept is None else kept
    out = out.select(*items.columns)
    return out if count is None else out.orderBy("attempt").limit(count)


def graph_context(edges: DataFrame, mentions: DataFrame, anchor, count: int, per_round: int = 1, damping: float = 0.85, decay: float = DECAY, iterations: int = 100) -> DataFrame:
    """Chunks (chunk_id, round) to make a question of: the anchor (round 0), then the best by PageRank from the entities of what is chosen.

    Edges (src, dst, weight) count both ways; mentions (chunk_id, entity_id) say where a chunk's entities are. An entity of the
    anchor weighs 1, one that came in round n ``decay`` to the power n. No row if the anchor has no entity or fewer than ``count`` are found.
    """
    both = stage(graph_query.undirected(edges), "context-edges")
    mentions = mentions.select("chunk_id", "entity_id").distinct()
    chunks = mentions.select("chunk_id").distinct()
    chosen = stage(chunks.filter(F.col("chunk_id") == F.lit(anchor)).withColumn("round", F.lit(0)), "context")
    found = chosen.count()
    turn = 1
    while 0 < found < count:
        reset = mentions.join(F.broadcast(chosen), "chunk_id").groupBy(F.col("entity_id").alias("node")).agg(F.max(F.pow(F.lit(decay), "round")).alias("p"))
        scores = graph_query.pagerank_batch(both, reset.withColumn("query_id", F.lit(0)), damping, iterations)
        new = scores.join(chunks, F.col("node") == F.col("chunk_id")).join(F.broadcast(chosen), "chunk_id", "left_anti").filter("score > 0")
        new = new.orderBy(F.col("score").desc(), "chunk_id").limit(min(per_round, count - found)).select("chunk_id", F.lit(turn).alias("round"))
        grown = stage(chosen.unionByName(new), "context")
        discard(chosen)
        chosen, had, found = grown, found, grown.count()
        turn += 1
        if found == had:
            return chosen.limit(0)
    return chosen
