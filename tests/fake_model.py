"""A deterministic stand-in for an external model, for tests only. It reads the rows back out of the prompt, labels each answer
with the rule set (in Python) and answers in JSON, with faults injected by
the first answer of a batch so that every fallback path is exercised:

* first answer ``pending``  -> prose without an array (whole batch falls back)
* first answer ``TBC``      -> the array inside a Markdown fence
* first answer ``ok``       -> the last object is missing (that row falls back)
* first answer ``.``        -> prose around the array
* first answer ``fixed``    -> confidences written as JSON strings
"""

from __future__ import annotations

import json
import re

from replysift.config import DEFAULT_RULES, RuleSet
from replysift.functions.rules import cue_regex

def prompt_answers(prompt: str) -> list[str]:
    """The answers of the JSON lines after the "LINES: n" line."""
    head, _, body = prompt.rpartition("\nLINES: ")
    assert head
    return [json.loads(line)["answer"] for line in body.split("\n")[1:]]


def rule_result(text: str, rules: RuleSet = DEFAULT_RULES) -> tuple[str, float, str]:
    t = text.lower().replace("’", "'")
    found = re.findall(cue_regex(rules), t)
    counts = []
    for r in rules.rules:
        counts.append(sum(1 for m in found if m in r.cues or (r.question_mark and m == "?")))
    total = sum(counts)
    label, win = rules.default_label, 0
    for i, (r, n) in enumerate(zip(rules.rules, counts)):
        if n > 0 and (r.overriding or all(n >= later for later in counts[i + 1:])):
            label, win = r.label, n
            break
    conf = rules.no_cue_confidence if total == 0 else rules.base_confidence + (rules.share_weight * float(win)) / float(total)
    reason = "cues:" + "".join(
        (", " if i else " ") + r.label + " " + str(n) for i, (r, n) in enumerate(zip(rules.rules, counts))
    )
    return label, conf, reason


def reply_for(prompt: str, rules: RuleSet = DEFAULT_RULES) -> str | None:
    answers = prompt_answers(prompt)
    first = answers[0] if answers else ""
    objs = []
    for i, a in enumerate(answers):
        label, conf, reason = rule_result(a, rules)
        objs.append({"index": i, "classification": label, "confidence": conf, "reasoning": reason})
    if first == "pending":
        return "Sorry, these answers could not be classified."
    if first == "fixed":
        for o in objs:
            o["confidence"] = repr(o["confidence"])
    if first == "ok":
        objs = objs[:-1]
    text = json.dumps(objs)
    if first == "TBC":
        return "```json\n" + text + "\n```"
    if first == ".":
        return "Here are the results:\n" + text + "\nLet me know if more is needed."
    return text


def keyword_model_factory(rules: RuleSet = DEFAULT_RULES):
    """Factory in the shape ``classify_with_model`` expects."""
    def factory():
        return lambda prompt: reply_for(prompt, rules)
    return factory
