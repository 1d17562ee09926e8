"""Datasets: scans by extension, row builders, supervised and preference assembly, and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidemill.functions import arrays as A
from tidemill.functions.registry import load_object

MESSAGE = "struct<role: string, content: string>"
PROMPTS = f"data_source string, prompt array<{MESSAGE}>, ability string, reward_model struct<style: string, ground_truth: string>, extra_info struct<split: string, index: long, answer: string, question: string>"


def scan(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType | None = None) -> DataFrame:
    """Parquet, JSON or JSON Lines by extension, many files as one table; another extension raises."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for kind, ends in (("parquet", (".parquet",)), ("json", (".json", ".jsonl"))):
        some = [p for p in paths if p.rstrip("/").endswith(ends)]
        if some:
            reader = spark.read.schema(schema) if schema is not None else spark.read
            one = reader.format(kind).load(some)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    unknown = [p for p in paths if not p.rstrip("/").endswith((".parquet", ".json", ".jsonl"))]
    if unknown or out is None:
        raise ValueError(f"no reader for {unknown or paths}")
    return out


def scan_pairs(spark: SparkSession, paths: str | Sequence[str], *, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The three columns of preference pairs, and no others."""
    return scan(spark, paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def scan_messages(spark: SparkSession, paths: str | Sequence[str], *, messages: str = "messages", optional: Sequence[str] = ("tools", "enable_thinking")) -> DataFrame:
    """Messages and, where there are such columns, tools and switches."""
    df = scan(spark, paths)
    return df.select(F.col(messages).alias("messages"), *[c for c in optional if c in df.columns])


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with blank lines skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_scenarios(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Nested scenario files (sessions of rounds) as text and image records with ids and synthetic timestamps ``dateTNNNN``.

    The schema has scenario, sessions: array of struct(session_id, date, dialogues: array of struct(round, user, assistant, images)).
    """
    raw = spark.read.schema(schema).option("multiLine", True).json(paths)
    return scenario_records(raw)


def scenario_records(raw: DataFrame) -> DataFrame:
    sessions = raw.select("scenario", F.explode("sessions").alias("s"))
    rounds = sessions.select("scenario", "s.session_id", "s.date", F.posexplode("s.dialogues").alias("place", "d"))
    key = F.concat_ws(":", "scenario", "session_id", F.col("d.round").cast("string"))
    stamp = F.concat("date", F.lit("T"), F.lpad((F.col("place") + 1).cast("string"), 4, "0"))
    base = [key.alias("turn_id"), stamp.alias("timestamp"), F.concat_ws(":", "scenario", "session_id").alias("session_key"), (F.col("place") + 1).alias("turn_index")]
    text = rounds.select(F.concat(F.lit("txt:"), key).alias("memory_id"), *base, F.lit("text").alias("modality"), F.concat_ws("\n", "d.user", "d.assistant").alias("content"), F.lit(None).cast("string").alias("raw_pointer"))
    images = rounds.select("*", F.posexplode("d.images").alias("n", "image")).select(F.concat(F.lit("img:"), key, F.lit(":"), F.col("n").cast("string")).alias("memory_id"), *base, F.lit("image").alias("modality"), F.lit("").alias("content"), F.col("image").alias("raw_pointer"))
    return text.unionByName(images)


def questions(raw: DataFrame) -> DataFrame:
    """(scenario, qa_id, question, answer, turn_ids): questions with their clues as turn ids."""
    qas = raw.select("scenario", F.posexplode("qas").alias("qa_id", "q"))
    return qas.select("scenario", "qa_id", "q.question", "q.answer", F.transform("q.clues", lambda c: F.concat(F.col("scenario"), F.lit(":"), c)).alias("turn_ids"))


def custom_dataset(where: str, name: str, spark: SparkSession, *args, **options) -> DataFrame:
    """A DataFrame from a function of one's own; anything else it returns raises."""
    out = load_object(where, name)(spark, *args, **options)
    if not isinstance(out, DataFrame):
        raise TypeError(f"{name} must return a DataFrame")
    return out


# Row builders
def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_rows(df: DataFrame, *, source: str, question: Column, truth: Column, answer: Column, split: str, ability: str = "math", instruction: str = "", system: str | None = None, index: Column | None = None, style: str = "rule", tools: Column | None = None) -> DataFrame:
    """Rows of the prompt schema from a question and its answer."""
    text = F.concat(question, F.lit(" " + instruction)) if instruction else question
    prompt = F.array(*([message("system", F.lit(system))] if system else []), message("user", text))
    extra = [F.lit(split).alias("split"), (index if index is not None else F.col("row_id")).alias("index"), answer.alias("answer"), question.alias("question"), *([tools.alias("tools_kwargs")] if tools is not None else [])]
    return df.select(F.lit(source).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(*extra).alias("extra_info"))


def search_rows(df: DataFrame, *, split: str, prefix: str, system: str) -> DataFrame:
    """Rows for search agents: golds from the reward model or else from golden_answers, the source tagged."""
    golds = F.coalesce("reward_model.ground_truth.target", "golden_answers", F.array().cast("array<string>"))
    source = F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit("")))
    truth = F.struct(golds.alias("target"))
    tools = F.struct(F.struct(truth.alias("ground_truth"), F.col("question"), source.alias("data_source")).alias("create_kwargs"))
    extra = F.struct(F.lit(split).alias("split"), F.col("row_id").alias("index"), F.lit(True).alias("need_tools_kwargs"), F.col("question"), F.struct(tools.alias("search")).alias("tools_kwargs"))
    return df.select(source.alias("data_source"), F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix), "question"))).alias("prompt"), F.lit("fact-reasoning").alias("ability"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"))


def memory_rows(samples: DataFrame, records: DataFrame, *, by: str = "scenario") -> DataFrame:
    """Samples with all records of their scenario nested, as training rows."""
    nested = records.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("timestamp", "memory_id", "turn_id", "content"))).alias("records"))
    joined = samples.join(nested, by, "left")
    tools = F.struct(F.struct(F.coalesce("records", F.array().cast(dict(nested.dtypes)["records"])).alias("records"), "question").alias("create_kwargs"))
    return joined.select(F.lit("memory").alias("data_source"), F.array(message("user", F.col("question"))).alias("prompt"), F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"), F.struct(F.struct(tools.alias("memory")).alias("tools_kwargs")).alias("extra_info"))


def actions_to_messages(df: DataFrame, *, question: str = "question", actions: str = "actions") -> DataFrame:
    """A question and a JSON list of actions as messages whose assistant turn calls tools."""
    parsed = F.from_json(F.col(actions), "array<map<string, string>>")
    calls = F.transform(parsed, lambda a: F.struct(F.upper(F.try_element_at(a, F.lit("tool"))).alias("name"), F.to_json(F.map_filter(a, lambda k, _: k != "tool")).alias("arguments")))
    said = F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content"), F.array().cast("array<struct<name: string, arguments: string>>").alias("tool_calls")), F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), calls.alias("tool_calls")))
    return df.withColumn("messages", said)


def pairs_to_supervised(df: DataFrame) -> DataFrame:
    """(row_id, part, prompt, response): the chosen answer, then the rejected one."""
    return df.select("row_id", F.posexplode(F.array("chosen", "rejected")).alias("part", "response"), "prompt")


# Token assembly
def supervised_rows(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", ids: str = "ids", header: int = 0, width: int | None = None, pad_id: int = 0, truncation: str = "right") -> DataFrame:
    """Conversations as input_ids, loss_mask and position_ids: turns in order; only an assistant's tokens are learned, without
    the ``header`` tokens that open its turn. With ``width`` rows are padded on the right or cut."""
    learned = F.transform(ids, lambda _, k: F.when((F.col(role) == "assistant") & (k >= header), 1).otherwise(0))
    grouped = turns.withColumn("_mask", learned).groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(ids).alias("i"), F.col("_mask").alias("m")))).alias("_t"))
    rows = grouped.select(conversation, F.flatten(F.transform("_t", lambda t: t["i"])).alias("input_ids"), F.flatten(F.transform("_t", lambda t: t["m"])).alias("loss_mask"))
    rows = rows.withColumns({"position_ids": F.transform("input_ids", lambda _, k: k), "attention_mask": F.transform("input_ids", lambda _: F.lit(1))})
    if width is None:
        return rows
    fill = {"input_ids": pad_id, "loss_mask": 0, "position_ids": 0, "attention_mask": 0}
    return rows.withColumns({c: A.fit_length(c, width, F.lit(v), truncation, left_pad=False) for c, v in fill.items()})


def preference_rows(df: DataFrame, *, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids", width: int, pad_id: int = 0, eos: int | None = None) -> DataFrame:
    """Prompt and answer of both sides, with an end token, padded on the right or cut to ``width``."""
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    side = lambda c: F.concat(F.col(prompt), F.col(c), end)
    return df.withColumns({f"{n}_input": A.fit_length(side(c), width, F.lit(pad_id), "right", left_pad=False) for n, c in (("chosen", chosen), ("rejected", rejected))})


def flat_ids(value) -> list[int]:
    """Token ids of whatever a tokenizer returned: a list, a nested list of one, a mapping with input_ids or an object with ids."""
    if isinstance(value, dict):
        value = value["input_ids"]
    value = getattr(value, "input_ids", getattr(value, "ids", value))
    value = value.tolist() if hasattr(value, "tolist") else list(value)
    if value and isinstance(value[0], (list, tuple)):
        if len(value) != 1:
            raise ValueError("ids of more than one text")
        value = list(value[0])
    return [int(x) for x in value]


def flat_ids_of(df: DataFrame, column: str) -> Column:
    """``flat_ids`` of a column, by its type: a struct with input_ids or ids, an array of arrays or an array of ids.

    An outer array of more than one text raises when it is read.
    """
    value, kind = F.col(column), df.schema[column].dataType
    while isinstance(kind, StructType):
        name = next(n for n in ("input_ids", "ids") if n in kind.fieldNames())
        value, kind = value[name], kind[name].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        several = F.raise_error(F.lit("ids of more than one text")).cast(kind.elementType)
        value = F.when(F.size(value) == 0, F.array().cast(kind.elementType)).when(F.size(value) == 1, F.try_element_at(value, F.lit(1))).otherwise(several)
    return value.cast("array<long>")


# Key-value batches and snapshots
def read_keys(values: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns of the wanted keys (key, ord), in their order."""
    return keys.join(values.select("traj_key", *columns), "traj_key").select("ord", "traj_key", *columns)


def put_columns(values: DataFrame, new: DataFrame) -> DataFrame:
    """New columns for existing keys; a column that is there is replaced."""
    return values.drop(*[c for c in new.columns if c != "traj_key"]).join(new, "traj_key", "left")


def clear_keys(values: DataFrame, keys: DataFrame) -> DataFrame:
    return values.join(keys.select("traj_key"), "traj_key", "left_anti")


def list_keys(tags: DataFrame) -> DataFrame:
    return tags.groupBy("partition_id", "status").agg(F.count("*").alias("n"))


def snapshot_for(steps: DataFrame, wanted: int) -> DataFrame:
    """One row (step): the wanted step's snapshot, else the largest earlier, else the smallest later one, else -1."""
    s = F.col("step")
    return steps.agg(F.coalesce(F.max(F.when(s <= wanted, s)), F.min(F.when(s > wanted, s)), F.lit(-1)).alias("step"))


# Sinks
def save(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A batch as Parquet, and its metadata as one JSON row beside it."""
    df.write.mode("overwrite").parquet(f"{path}/batch")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/batch"), json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])


def to_wire(df: DataFrame) -> list[bytes]:
    """A bounded batch as Arrow IPC messages, a chunk each; ``from_wire`` undoes it."""
    import pyarrow as pa

    table, out = df.toArrow(), []
    for batch in table.to_batches(max_chunksize=65_536) or [pa.RecordBatch.from_pylist([], schema=table.schema)]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_batch(batch)
        out.append(sink.getvalue().to_pybytes())
    return out


def wire_messages(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """(message): a batch of any size as Arrow IPC messages of at most ``rows`` rows, made where the rows are."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["message"])

    return df.mapInArrow(pack, "message binary")


def from_messages(messages: DataFrame, schema: str | StructType) -> DataFrame:
    """Undoes ``wire_messages``; messages may come in any order."""

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for message in batch.column(0):
                yield from pa.ipc.open_stream(message.as_buffer())

    return messages.mapInArrow(unpack, schema)


def from_wire(spark: SparkSession, messages: Sequence[bytes]) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.concat_tables(pa.ipc.open_stream(m).read_all() for m in messages))


def dump_generations(df: DataFrame, path: str, step: int) -> None:
    """One folder of JSON Lines a step."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A Parquet folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def log_metrics(metrics: DataFrame, step: int, sinks: Sequence[Callable[[DataFrame], None]] = (), path: str | None = None) -> DataFrame:
    """Metrics of a step to a JSON Lines folder and to any number of other sinks."""
    rows = metrics.select(F.lit(step).alias("step"), "metric", "value")
    if path is not None:
        rows.write.mode("append").json(path)
    for sink in sinks:
        sink(rows)
    return rows


def supervised_file(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """JSON Lines of questions and actions to Parquet of messages."""
    actions_to_messages(read_lines(spark, source, schema)).write.mode("overwrite").parquet(target)


def resume_after(batches: DataFrame, epoch: int, batch: int) -> DataFrame:
    """The batches that come after a saved place."""
    return batches.filter((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("batch") > batch)))
