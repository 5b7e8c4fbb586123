"""Chat messages: prompts, templates of models, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def merge_system(messages: Column) -> Column:
    """A system message goes, with a line end, before the user message that follows it; any other system message goes away."""
    indexed = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), i.alias("i")))

    def merged(x: Column) -> Column:
        before = F.get(messages, x["i"] - 1)
        led = (x["i"] > 0) & (x["role"] == "user") & (before["role"] == "system")
        return message(x["role"], F.when(led, F.concat(before["content"], F.lit("\n"), x["content"])).otherwise(x["content"]))

    return F.transform(F.filter(indexed, lambda x: x["role"] != "system"), merged)


#: What stands before a message by role (user, assistant, anything else), and what ends the prompt.
PREFIXES = {
    "claude": ("Human: ", "Assistant: ", "Instruction: ", "Assistant:"),
    "phi": ("Instruct: ", "Output: ", "Output: ", "Output:"),
    "plain": ("", "Completion: ", "", "Completion: "),
}
#: The template whose words a model's name contains first, in this order.
MODEL_WORDS = {
    "chatml": ("orca", "default"),
    "llama3": ("llama3",),
    "instruct": ("mistral_instruct", "mixtral", "biomistral", "llama"),
    "zephyr": ("zephyr",),
    "claude": ("claude", "llama2", "jurassic"),
    "phi": ("phi",),
    "stablelm": ("stablelm",),
}


def _joined(messages: Column, line: Callable[[Column], Column], tail: str) -> Column:
    return F.concat(F.array_join(F.transform(messages, line), ""), F.lit(tail))


def prefixed_prompt(kind: str) -> Callable[[Column], Column]:
    user, assistant, other, tail = PREFIXES[kind]

    def prompt(messages: Column) -> Column:
        shown = merge_system(messages) if kind == "claude" else messages
        return _joined(shown, lambda m: F.concat(F.when(m["role"] == "user", user).when(m["role"] == "assistant", assistant).otherwise(other), m["content"], F.lit(" \n")), tail)

    return prompt


def chatml_prompt(messages: Column) -> Column:
    return _joined(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")), "<|im_start|>assistant\n")


def instruct_prompt(messages: Column) -> Column:
    """Turns in brackets, system merged; the template itself ships with the model, so this approximates it."""
    return _joined(merge_system(messages), lambda m: F.when(m["role"] == "user", F.concat(F.lit("[INST] "), m["content"], F.lit(" [/INST]"))).otherwise(F.concat(m["content"], F.lit("</s>"))), "")


def marked_prompt(open_: str, close: str) -> Callable[[Column], Column]:
    """Role marks before and an end mark after each message; approximates templates that ship with their models."""
    return lambda messages: _joined(messages, lambda m: F.concat(F.replace(F.lit(open_), F.lit("{role}"), m["role"]), m["content"], F.lit(close)), open_.replace("{role}", "assistant"))


TEMPLATES = {
    "chatml": chatml_prompt,
    "llama3": marked_prompt("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>"),
    "instruct": instruct_prompt,
    "zephyr": marked_prompt("<|{role}|>\n", "</s>\n"),
    "stablelm": marked_prompt("<|{role}|>\n", "<|endoftext|>\n"),
} | {k: prefixed_prompt(k) for k in PREFIXES}


def prompt_for(model: str, messages: Column) -> Column:
    """The template that the model's name asks for, else the plain one."""
    kind = next((k for k, words in MODEL_WORDS.items() if any(w in model for w in words)), "plain")
    return TEMPLATES[kind](messages)


def edit_message(messages: Column, at: int, before: str = "", after: str = "") -> Column:
    """Text put before and after the content of one message."""
    return F.transform(messages, lambda m, i: message(m["role"], F.when(i == at, F.concat(F.lit(before), m["content"], F.lit(after))).otherwise(m["content"])))


def fill_template(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def training_dialogue(system: str | None, question: Column, answer: Column) -> Column:
    """System, user and assistant turn; without the first for models that have none."""
    turns = [message("user", question), message("assistant", answer)]
    return F.array(*([message("system", F.lit(system))] if system is not None else []), *turns)


def first_line(c: Column) -> Column:
    return F.btrim(F.split(F.btrim(c, F.lit(BLANKS)), "\n", -1)[0], F.lit(BLANKS))


def yes_no(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("yes")), "yes").when(F.contains(low, F.lit("no")), "no").otherwise(F.btrim(c, F.lit(BLANKS)))


def answer_label(c: Column) -> Column:
    """negative is looked for first, then positive; case matters."""
    return F.when(F.contains(c, F.lit("negative")), "negative").when(F.contains(c, F.lit("positive")), "positive").otherwise("na")


#: Phrases with which a reasoned answer states its conclusion, in the order in which they are looked for.
CONCLUSIONS = (
    "therefore the correct answer",
    "therefore, the correct answer",
    "therefore the correct alternative",
    "therefore, the correct alternative",
    "therefore the correct relation",
    "therefore, the correct relation",
)
_CONCLUDED = r"\b(positive|negative|relate| na|na[.\n])\b"


def conclusion(c: Column) -> Column:
    """What follows the first phrase found, lower-cased; null where there is none."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for phrase in reversed(CONCLUSIONS):
        at = F.position(F.lit(phrase), low)
        out = F.when(at > 0, F.substring(low, at, F.char_length(low))).otherwise(out)
    return out


def concluded_label(c: Column) -> Column:
    """The first label in the conclusion; empty where it has none, null without a conclusion."""
    found = F.regexp_extract(F.replace(conclusion(c), F.lit("'"), F.lit("")), _CONCLUDED, 1)
    return F.when(F.contains(found, F.lit("na")), "na").otherwise(found)


def keywords(c: Column, microbe: Column, disease: Column) -> Column:
    """First line without the names of the entities, disease first."""
    return F.replace(F.replace(F.btrim(F.split(c, "\n", -1)[0], F.lit(BLANKS)), disease, F.lit("")), microbe, F.lit(""))


def substitute_entities(c: Column, old_disease: Column, new_disease: Column, old_microbe: Column, new_microbe: Column) -> Column:
    """Disease first, then microbe."""
    return F.replace(F.replace(c, old_disease, new_disease), old_microbe, new_microbe)


def usable_lines(generated: Column, microbe: Column, disease: Column) -> Column:
    """Lines of more than three characters that name both entities."""
    lines = F.split(F.lower(generated), "\n", -1)
    return F.filter(lines, lambda x: (F.char_length(x) > 3) & F.contains(x, F.lower(microbe)) & F.contains(x, F.lower(disease)))


def cuis_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(C[0-9]+)"), 1)
