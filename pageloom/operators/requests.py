"""Request tables for a model outside, and reading its responses.

A request is a row (request_id, step, model, prompt, system, max_completion,
temperature); a response is a row (request_id, text, error).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.ratings import parse_rating
from pageloom.functions.text import count_tokens, strip, truncate_tokens
from pageloom.settings import Settings, context_tokens

# Marks of the texts in a merge request, and the one-word answer
# for a chunk without details.
RAW_TITLE, RAW_MARK = "# Raw Extracted Details for: ", "\n\n---\n[Extracted Chunk Details]\n---\n\n"
NEXT_TITLE, NEXT_MARK = "# Intermediate Summaries for: ", "\n\n---\n[Intermediate Summary]\n---\n\n"
IRRELEVANT = "IRRELEVANT"
# A topic's name is shortened to this in the title of a merge request, so that a title's room is known.
MAX_NAME_CHARS = 400
MIN_EXTRACT_CHARS = 30


@dataclass(frozen=True)
class Prompts:
    """Instruction texts; {url}, {topic} and {text} are filled in from columns."""

    extract_system: str = (
        "Extract the technical details of this documentation chunk: code with its imports, signatures, "
        "parameters, settings, steps and definitions. Keep the original wording and put code between "
        f"``` marks. If there are none, answer with the one word {IRRELEVANT}."
    )
    extract: str = 'Chunk of the web page {url}:\n"""\n{text}\n"""\n\nDetails:'
    merge_system: str = (
        "Join these extracted details about '{topic}' into one plain-text document. Keep code, steps, "
        "settings and signatures, drop repeated explanations, add nothing."
    )
    merge_next_system: str = (
        "Join these partial documents about '{topic}' into one plain-text document. Keep every distinct "
        "example, step and setting, drop repeated sentences, add nothing."
    )
    merge: str = 'Texts about \'{topic}\':\n"""\n{text}\n"""\n\nDocument:'
    rate_system: str = (
        "Judge this generated documentation for '{topic}' by clarity, completeness, conciseness and "
        "formatting. Answer in this form:\n**Overall Quality Rating:** [1 to 10]\n**Justification:**\n"
        "[reasons]\n**Suggestions for Improvement:**\n[suggestions]"
    )
    rate: str = 'Documentation of \'{topic}\':\n"""\n{text}\n"""\n\nAssessment:'
    topic_system: str = "Name the subject of a web page."
    topic: str = (
        'Beginning of the web page {url}:\n"""\n{text}\n"""\n\n'
        "Answer with nothing but a title of three to seven words for its subject.\n\nTitle:"
    )


def fill(template: str, **columns: Column) -> Column:
    """A template with its {names} replaced by columns, as one concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(columns[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def request_id(step: str, *keys: Column) -> Column:
    return F.sha1(F.encode(F.concat_ws("|", F.lit(step), *[k.cast("string") for k in keys]), "UTF-8"))


def _request(step: str, model: str, key: list[Column], prompt: Column, system: Column, cap: Column, temp: float):
    return [
        request_id(step, *key).alias("request_id"),
        F.lit(step).alias("step"),
        F.lit(model).alias("model"),
        prompt.alias("prompt"),
        system.alias("system"),
        cap.cast("int").alias("max_completion"),
        F.lit(temp).alias("temperature"),
    ]


def extract_requests(
    chunks: DataFrame, model: str = Settings.extraction_model, prompts: Prompts = Prompts()
) -> DataFrame:
    """One request per chunk(url, chunk_no, text, n_tokens); keeps url and chunk_no."""
    cap = F.least(F.lit(4096), F.greatest(F.lit(600), F.floor(F.col("n_tokens") * F.lit(0.40))))
    prompt = fill(prompts.extract, url=F.col("url"), text=F.col("text"))
    columns = _request(
        "extract", model, [F.col("url"), F.col("chunk_no")], prompt, F.lit(prompts.extract_system), cap, 0.05
    )
    return chunks.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("url", "chunk_no", *columns)


def merge_room(model: str = Settings.merge_model, completion: int = Settings.merge_completion) -> int:
    """Tokens of text a merge request has room for."""
    return context_tokens(model) - completion - 500


def _cut(text: Column, kept: Column) -> Column:
    """How many characters of a text were not kept."""
    return (F.coalesce(F.length(text), F.lit(0)) - F.coalesce(F.length(kept), F.lit(0))).cast("bigint").alias("n_chars_cut")


def merge_requests(
    joined: DataFrame, model: str = Settings.merge_model, completion: int = Settings.merge_completion,
    prompts: Prompts = Prompts(),
) -> DataFrame:
    """One request per batch of joined(topic, level, batch_no, text[, name]).

    A text above the model's room is cut to it, and n_chars_cut says by how much;
    batches planned by plan_requests are never cut.
    """
    room = merge_room(model, completion)
    name = F.col("name" if "name" in joined.columns else "topic")
    text = truncate_tokens(F.col("text"), room)
    system = F.when(F.col("level") == 0, fill(prompts.merge_system, topic=name)).otherwise(
        fill(prompts.merge_next_system, topic=name)
    )
    columns = _request(
        "merge", model, [F.col("topic"), F.col("level"), F.col("batch_no")],
        fill(prompts.merge, topic=name, text=text), system, F.lit(completion), 0.1,
    )
    return joined.select("topic", "level", "batch_no", *columns, _cut(F.col("text"), text))


def rating_requests(
    docs: DataFrame, model: str = Settings.rating_model, prompts: Prompts = Prompts()
) -> DataFrame:
    """One request per non-empty doc(topic, text[, name]), on the beginning of a text above the model's room.

    n_chars_cut says how much of it is not seen.
    """
    name = F.col("name" if "name" in docs.columns else "topic")
    text = truncate_tokens(F.col("text"), context_tokens(model) - 1000)
    columns = _request(
        "rate", model, [F.col("topic")], fill(prompts.rate, topic=name, text=text),
        fill(prompts.rate_system, topic=name), F.lit(None), 0.3,
    )
    return docs.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("topic", *columns, _cut(F.col("text"), text))


def topic_requests(
    clean: DataFrame, model: str = Settings.rating_model, max_tokens: int = Settings.topic_tokens,
    prompts: Prompts = Prompts(),
) -> DataFrame:
    """One request per non-empty clean(url, text), on the beginning of the text."""
    text = truncate_tokens(F.col("text"), max_tokens)
    columns = _request(
        "topic", model, [F.col("url")], fill(prompts.topic, url=F.col("url"), text=text),
        F.lit(prompts.topic_system), F.lit(50), 0.1,
    )
    return clean.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("url", *columns)


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with response (null if missing, failed or empty) and error; ids are unique."""
    found = responses.select("request_id", F.col("text").alias("_text"), "error")
    joined = requests.join(found, "request_id", "left")
    text = strip(F.col("_text"))
    return joined.withColumn("response", F.when(F.col("error").isNull() & (text != ""), text)).drop("_text")


def valid_extracts(attached: DataFrame) -> DataFrame:
    """outcome failed, irrelevant, too_short or kept; analysis is the text of a kept one."""
    text = F.col("response")
    outcome = (
        F.when(F.coalesce(text, F.lit("")) == "", "failed")
        .when(F.upper(strip(text)) == IRRELEVANT, "irrelevant")
        .when(F.length(text) < MIN_EXTRACT_CHARS, "too_short")
        .otherwise("kept")
    )
    return attached.withColumn("outcome", outcome).withColumn("analysis", F.when(F.col("outcome") == "kept", text))


def extract_summary(extracts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests and tokens kept, by outcome."""
    return extracts.groupBy(*(by or []), "outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(count_tokens(F.col("analysis"))), F.lit(0)).alias("n_tokens"),
    )


def parse_ratings(attached: DataFrame, strict: bool = False) -> DataFrame:
    """topic and the four rating columns of every answered rating request."""
    rated = attached.withColumn("_rating", parse_rating(F.col("response"), strict))
    return rated.filter(F.col("_rating").isNotNull()).select("topic", "_rating.*")


def echo_responses(requests: DataFrame) -> DataFrame:
    """A stand-in for a model: the prompt cut to the completion cap (4 characters a token)."""
    cap = F.coalesce(F.col("max_completion"), F.lit(1000)) * 4
    return requests.select(
        "request_id", F.substring("prompt", F.lit(1), cap).alias("text"), F.lit(None).cast("string").alias("error")
    )


def digest_responses(requests: DataFrame) -> DataFrame:
    """A stand-in for a model that shows what it was asked: length and md5 of the whole prompt, then the prompt cut to the cap."""
    cap = F.coalesce(F.col("max_completion"), F.lit(1000)) * 4
    whole = F.concat_ws(" ", F.length("prompt").cast("string"), F.md5(F.encode("prompt", "UTF-8")), "prompt")
    return requests.select(
        "request_id", F.substring(whole, F.lit(1), cap).alias("text"), F.lit(None).cast("string").alias("error")
    )
