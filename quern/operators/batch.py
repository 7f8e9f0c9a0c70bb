"""Training samples and batches, prompts, logits and training metrics, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def head(ids: Column, most: int | Column) -> Column:
    """The first ``most`` ids."""
    return F.slice(ids, F.lit(1), F.lit(most) if isinstance(most, int) else most)


def tail(ids: Column, room: Column) -> Column:
    """The last ``room`` ids; all of them where the room is 0 (as a slice from -0)."""
    return F.when(room <= 0, ids).otherwise(F.slice(ids, F.greatest(F.size(ids) - room + 1, F.lit(1)), F.greatest(room, F.lit(1))))


def sample(task: Column, ids: Column, before: Column, eos: Column, ae: int, end: int, pad: int, most: int, most_context: int) -> Column:
    """Struct (context_ids, input_ids, labels) of a sample.

    ntp: the ids; reconstruction: the sign ``ae`` before them, which has no label, and the ids as
    context; continuation: the predecessor's ids as context.  Room for the signs is kept free.
    """
    rec = task == "reconstruction"
    room = F.lit(most) - eos.cast("int") - rec.cast("int")
    body = F.concat(F.slice(ids, F.lit(1), room), F.when(eos, F.array(F.lit(end))).otherwise(F.array().cast("array<int>")))
    inputs = F.when(rec, F.concat(F.array(F.lit(ae)), body)).otherwise(body)
    labels = F.when(rec, F.concat(F.array(F.lit(IGNORED)), body)).otherwise(body)
    context = F.when(rec, head(ids, most_context)).when(task == "continuation", head(before, most_context)).otherwise(F.array(F.lit(pad)))
    return F.struct(context.alias("context_ids"), inputs.alias("input_ids"), labels.alias("labels"))


def pad_batch(df: DataFrame, batch: str, context: str, inputs: str, labels: str, pad: int) -> DataFrame:
    """Pads contexts on the left and inputs and labels on the right to the longest of their batch, with masks by true length."""
    w = Window.partitionBy(batch)
    out = df.withColumn("_c", F.max(F.size(context)).over(w)).withColumn("_i", F.max(F.size(inputs)).over(w))

    def fill(value: int, n: Column) -> Column:
        return F.array_repeat(F.lit(value), n.cast("int"))

    nc, ni = F.col("_c") - F.size(context), F.col("_i") - F.size(inputs)
    return out.withColumns(
        {
            "context_mask": F.concat(fill(0, nc), fill(1, F.size(context))),
            "input_mask": F.concat(fill(1, F.size(inputs)), fill(0, ni)),
            context: F.concat(fill(pad, nc), F.col(context)),
            inputs: F.concat(F.col(inputs), fill(pad, ni)),
            labels: F.concat(F.col(labels), fill(IGNORED, ni)),
        }
    ).drop("_c", "_i")


def memory_slots(key: Column, most: int, seed: str = "42") -> Column:
    """A value in [1, most] by the md5 of seed and key: one a sample, or one a batch if the batch is the key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(most)) + 1


def sample_slots(task: Column, key: Column, most: int, seed: str = "42") -> Column:
    """Memory slots of a sample: none for ntp; with a batch as key all others of the batch share one value."""
    return F.when(task == "ntp", F.lit(0).cast("bigint")).otherwise(memory_slots(key, most, seed))


def task_of(slots: Column, first_id: Column, ae: int) -> Column:
    """Task of a sample by what is in it: no slots, the sign of reconstruction in front, or neither."""
    return F.when(slots == 0, "ntp").when(F.coalesce(first_id == ae, F.lit(False)), "reconstruction").otherwise("continuation")


def chat(df: DataFrame, key: str, turn: str, role: str, text: str, template: str) -> DataFrame:
    """``key, prompt``: the turns of a conversation as one text; templates none, chatml and simple.

    Null texts are ''.  A conversation is one row of the result, so it has to fit one.
    """
    t = F.coalesce(F.col("_x.t"), F.lit(""))
    r = F.col("_x.r")
    own = df.select(key, F.struct(F.col(turn).alias("n"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")).alias("_x"))
    if template == "none":
        line, end = t, "\n"
    elif template == "chatml":
        line, end = F.concat(F.lit("<|im_start|>"), r, F.lit("\n"), t, F.lit("<|im_end|>")), "\n<|im_start|>assistant\n"
    elif template == "simple":
        name = F.when(r == "user", "User: ").when(r == "assistant", "Assistant: ")
        line, end = F.concat(name, t), "\nAssistant:"
    else:
        raise ValueError(f"template {template!r} is none of none, chatml, simple")
    own = own.withColumn("_l", line).filter("_l is not null")
    listed = F.array_sort(F.collect_list(F.struct("_x.n", "_l")))
    return own.groupBy(key).agg(F.concat(F.array_join(F.transform(listed, lambda x: x["_l"]), "\n"), F.lit(end)).alias("prompt"))


def few_shot(df: DataFrame, order: str, question: str, answer: str, shots: int = 2) -> DataFrame:
    """``order, text, label``: the first ``shots`` records with their answers before each other question."""
    first = df.orderBy(order).limit(shots)
    shown = F.concat(F.col(question), F.lit("\n答案："), F.coalesce(F.col(answer), F.lit("")))
    prompt = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("t")))), lambda x: x["t"]), "\n\n").alias("_p"))
    # One row, of `shots` records.
    rest = df.join(F.broadcast(first.select(order)), order, "left_anti").crossJoin(F.broadcast(prompt))
    return rest.select(order, F.concat("_p", F.lit("\n\n"), F.col(question), F.lit("\n答案：")).alias("text"), F.col(answer).alias("label"))


def top_k_top_p(df: DataFrame, key: str, token: str, logit: str, k: int, p: float, temperature: float = 1.0, seen: str | None = None, penalty: float = 1.0) -> DataFrame:
    """``key, token, prob``: the tokens that remain, with their probabilities renormalised.

    In order: the penalty on tokens ``seen`` (a boolean column), temperature, all at or above the k-th
    value (ties stay), then the nucleus up to the first token that crosses p.  Ties by token.
    """
    x = F.col(logit)
    if seen and penalty != 1.0:
        x = F.when(F.col(seen), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x)
    own = df.select(key, token, (x / max(temperature, 1e-7)).alias("_x"))
    by = Window.partitionBy(key).orderBy(F.desc("_x"))
    own = own.withColumn("_r", F.rank().over(by)).filter(F.col("_r") <= k) if k > 0 else own
    whole = Window.partitionBy(key)
    own = own.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(whole))).withColumn("_q", F.col("_e") / F.sum("_e").over(whole))
    before = Window.partitionBy(key).orderBy(F.desc("_x"), token).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_b", F.coalesce(F.sum("_q").over(before), F.lit(0.0))).filter(F.col("_b") <= p) if p < 1 else own
    return own.select(key, token, F.round(F.col("_e") / F.sum("_e").over(whole), 6).alias("prob"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.avg(loss), F.lit(100.0)))


def contributions(df: DataFrame, group: str, loss: str) -> DataFrame:
    """``group, n, mean, pct``: mean loss and the group's percent of the whole loss."""
    each = df.groupBy(group).agg(F.count(loss).alias("n"), F.avg(loss).alias("mean"))
    part = F.col("mean") * F.col("n")
    return each.withColumn("pct", F.round(100 * part / F.sum(part).over(Window.partitionBy(F.lit(0))), 4)).withColumn("mean", F.round("mean", 6))


def energy_shares(df: DataFrame, group: str, norm: str) -> DataFrame:
    """``group, energy, share``: squared norms and their share of the sum."""
    each = df.groupBy(group).agg(F.sum(F.col(norm) * F.col(norm)).alias("energy"))
    return each.withColumn("share", F.round(F.col("energy") / F.sum("energy").over(Window.partitionBy(F.lit(0))), 6)).withColumn("energy", F.round("energy", 4))


def learning_rate(step: Column, base: Column, freeze: int, ramp: int) -> Column:
    """0 for the first ``freeze`` steps, then a linear ramp of ``ramp`` steps, then the base."""
    return F.when(step < freeze, 0.0).when((step < freeze + ramp), base * (step - freeze) / max(1, ramp)).otherwise(base)


def exact_match(predicted: Column, label: Column) -> Column:
    """Share of equal pairs; a null on either side is unequal."""
    return F.avg(F.coalesce(predicted == label, F.lit(False)).cast("double"))
