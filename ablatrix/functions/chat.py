"""Column kernels for chat messages and their rendered form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The system text, and the marks of the default template.
SYSTEM_TEXT = "You are a helpful assistant."
BEGIN = "<|begin_of_text|>"
HEADER_OPEN = "<|start_header_id|>"
HEADER_CLOSE = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"


@dataclass(frozen=True)
class ChatTemplate:
    """Text around a conversation and around each message of a model family."""

    opening: str
    before_role: str
    after_role: str
    after_content: str

    def message(self, role: Column, content: Column) -> Column:
        return F.concat(
            F.lit(self.before_role), role, F.lit(self.after_role), content, F.lit(self.after_content)
        )

    def render(self, messages: Column) -> Column:
        body = F.transform(messages, lambda m: self.message(m["role"], m["content"]))
        return F.concat(F.lit(self.opening), F.array_join(body, ""))


TEMPLATES = {
    "header": ChatTemplate(BEGIN, HEADER_OPEN, HEADER_CLOSE + "\n\n", END_OF_TURN),
    "im": ChatTemplate("", "<|im_start|>", "\n", "<|im_end|>\n"),
}


def qa_messages(context: Column, question: Column, answer: Column) -> Column:
    """System, user and assistant messages of one QA row."""

    def say(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    asked = F.concat(F.lit("Question: "), question)
    user = F.when(context == "", asked).otherwise(
        F.concat(F.lit("Context: "), context, F.lit("\n"), asked)
    )
    return F.array(
        say("system", F.lit(SYSTEM_TEXT)),
        say("user", user),
        say("assistant", F.concat(F.lit("Answer: "), answer, F.lit("."))),
    )


def strip_system(text: Column) -> Column:
    """Drop everything through the first end-of-turn mark when a system header is present."""
    header = BEGIN + HEADER_OPEN + "system" + HEADER_CLOSE
    at = F.instr(text, END_OF_TURN)
    return F.when(
        text.contains(header) & (at > 0),
        F.substr(text, at + len(END_OF_TURN)),
    ).otherwise(text)
