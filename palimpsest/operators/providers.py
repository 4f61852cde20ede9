"""Translations of chat and response payloads for providers, and of providers' answers, as expressions over VARIANT.

A translation either holds whole or is refused with the first reason that applies; nothing of a payload is lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import array_text, at, given, items, keys, kind, let, object_text, quoted, string_at

PROVIDERS = ("anthropic", "gemini", "deepseek", "openai")
_SAMPLING = {"model", "stream", "temperature", "top_p", "tools", "tool_choice"}
#: Top-level fields that a provider's translation knows.
CHAT_FIELDS = {"anthropic": _SAMPLING | {"messages", "max_tokens", "response_format", "logit_bias"}}
CHAT_FIELDS["gemini"] = CHAT_FIELDS["anthropic"] | {"stop"}
RESPONSE_FIELDS = _SAMPLING | {"input", "max_output_tokens", "parallel_tool_calls", "previous_response_id", "instructions", "store", "metadata", "user"}
#: What a translation refuses although its field is known.
_NO_CHAT = ("tools", "tool_choice", "response_format", "logit_bias", "stop")
_NO_RESPONSES = ("tools", "tool_choice", "parallel_tool_calls", "store", "metadata")
_NO_FILLED = ("previous_response_id", "instructions", "user")
ROLES = ("system", "user", "assistant")
MESSAGES = "array<struct<role:string,text:string>>"


def _among(names: set[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, sorted(names)))


def _filled(v: Column, name: str) -> Column:
    """Whether a field holds more than an empty value."""
    return ~F.coalesce(F.to_json(at(v, f"$.{name}")), F.lit("null")).isin("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


def _other_fields(m: Column, *names: str) -> Column:
    """Whether a part has fields of other names, or is no object."""
    return F.coalesce(F.size(F.array_except(keys(m), _among(names))) > 0, F.lit(True))


def _chat_error(m: Column) -> Column:
    return (
        F.when(keys(m).isNull(), "messages").when(_other_fields(m, "role", "content"), "message field")
        .when(~F.coalesce(string_at(m, "$.role").isin(*ROLES), F.lit(False)), "roles")
        .when(~F.coalesce(kind(at(m, "$.content")), F.lit("VOID")).isin("STRING", "VOID"), "message content")
    )


def _block_error(b: Column) -> Column:
    text = kind(at(b, "$.text"))
    return (
        F.when(_other_fields(b, "type", "text") | F.coalesce(text != "STRING", F.lit(False)), "responses_input")
        .when(~F.coalesce(string_at(b, "$.type") == "input_text", F.lit(False)), "responses_multimodal").when(text.isNull(), "responses_input")
    )


def _first(errors: Column) -> Column:
    return F.get(F.array_compact(errors), 0)


def _role(m: Column) -> Column:
    return F.when(at(m, "$.role").isNull(), "user").otherwise(string_at(m, "$.role"))


def _input_error(m: Column) -> Column:
    blocks = items(m, "$.content")
    return (
        F.when(_other_fields(m, "role", "content") | _role(m).isNull() | (F.size(blocks) == 0), "responses_input")
        .when(~_role(m).isin(*ROLES), "responses_roles").otherwise(_first(F.transform(blocks, _block_error)))
    )


def _refusal(v: Column, provider: Column, chat: bool) -> Column:
    """Why a payload has no translation; null if it has one."""
    known = F.when(provider == "anthropic", _among(CHAT_FIELDS["anthropic"])).otherwise(_among(CHAT_FIELDS["gemini"])) if chat else _among(RESPONSE_FIELDS)
    field = F.size(F.array_except(keys(v), known)) > 0
    for name in _NO_CHAT if chat else _NO_RESPONSES:
        field = field | given(v, f"$.{name}").isNotNull()
    if chat:
        wrong = F.when(~F.coalesce(kind(at(v, "$.messages")), F.lit("VOID")).isin("ARRAY", "VOID"), "messages").otherwise(_first(F.transform(items(v, "$.messages"), _chat_error)))
        return F.when(field, "field").otherwise(wrong)
    for name in _NO_FILLED:
        field = field | _filled(v, name)
    sent = items(v, "$.input")
    wrong = F.when(kind(at(v, "$.input")) == "STRING", F.lit(None)).when(F.size(sent) == 0, "responses_input").when(F.exists(sent, lambda m: keys(m).isNull()), "responses_input").otherwise(_first(F.transform(sent, _input_error)))
    return F.when((provider == "deepseek") & _filled(v, "stream"), "responses_streaming").when(field, "field").otherwise(wrong)


def _messages(v: Column, chat: bool) -> Column:
    if chat:
        out = F.transform(items(v, "$.messages"), lambda m: F.struct(string_at(m, "$.role").alias("role"), F.coalesce(string_at(m, "$.content"), F.lit("")).alias("text")))
        return out.cast(MESSAGES)
    blocks = lambda m: F.array_join(F.transform(items(m, "$.content"), lambda b: string_at(b, "$.text")), "\n")
    read = F.transform(items(v, "$.input"), lambda m: F.struct(_role(m).alias("role"), blocks(m).alias("text"))).cast(MESSAGES)
    return F.when(kind(at(v, "$.input")) == "STRING", F.array(F.struct(F.lit("user").alias("role"), string_at(v, "$.input").alias("text"))).cast(MESSAGES)).otherwise(read)


def _request(v: Column, messages: Column, provider: Column, limit: str) -> Column:
    """The provider's request as JSON text, fields sorted by name."""
    said = F.filter(messages, lambda m: m["role"] != "system")
    system = F.filter(messages, lambda m: (m["role"] == "system") & (m["text"] != ""))
    text_part = lambda m: object_text({"text": quoted(m["text"])})
    model = F.coalesce(F.to_json(at(v, "$.model")), F.lit('""'))
    heat, top, most = given(v, "$.temperature"), given(v, "$.top_p"), given(v, f"$.{limit}")
    some = lambda c: F.when(F.size(system) > 0, c)
    anthropic = object_text({
        "model": model, "max_tokens": F.coalesce(most, F.lit("1024")), "temperature": heat, "top_p": top,
        "messages": array_text(F.transform(said, lambda m: object_text({"role": quoted(m["role"]), "content": array_text(F.array(object_text({"type": F.lit('"text"'), "text": quoted(m["text"])})))}))),
        "system": some(quoted(F.array_join(F.transform(system, lambda m: m["text"]), "\n"))),
    })
    settings = object_text({"maxOutputTokens": most, "temperature": heat, "topP": top})
    gemini = object_text({
        "contents": array_text(F.transform(said, lambda m: object_text({"role": F.when(m["role"] == "assistant", '"model"').otherwise('"user"'), "parts": array_text(F.array(text_part(m)))}))),
        "systemInstruction": some(object_text({"parts": array_text(F.transform(system, text_part))})), "generationConfig": F.when(settings != "{}", settings),
    })
    deepseek = object_text({
        "model": model, "max_tokens": most, "temperature": heat, "top_p": top,
        "messages": array_text(F.transform(messages, lambda m: object_text({"role": quoted(m["role"]), "content": quoted(m["text"])}))),
    })
    return F.when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(deepseek)


def provider_request(body: Column, provider: Column, route: str) -> Column:
    """struct<request, error> for each payload of a route (chat or responses) and its provider.

    The request is JSON text with sorted fields; OpenAI's is the payload itself, as is DeepSeek's for chats. error: body (no JSON
    object, or one with a field twice), provider (none of PROVIDERS), field (a field that is unknown or refused), messages, message
    field, roles, message content, responses_input, responses_roles, responses_multimodal, responses_streaming.
    """
    chat = route == "chat"
    same = provider.isin("openai", "deepseek") if chat else provider == "openai"

    def read(v: Column) -> Column:
        error = F.when(keys(v).isNull(), "body").when(~F.coalesce(provider.isin(*PROVIDERS), F.lit(False)), "provider").when(~same, _refusal(v, provider, chat))

        def made(e: Column) -> Column:
            translated = let(_messages(v, chat), lambda m: _request(v, m, provider, "max_tokens" if chat else "max_output_tokens"))
            return F.struct(F.when(e.isNull(), F.when(same, F.to_json(v)).otherwise(translated)).alias("request"), e.alias("error"))

        return let(error, made)

    return let(F.try_parse_json(body), read)


def answer_text(body: Column, provider: Column) -> Column:
    """The text of a provider's answer: its text parts joined by line ends; null if there is none."""
    blocks = F.from_json(body, "content array<struct<type:string,text:string>>, candidates array<struct<content:struct<parts:array<struct<text:string>>>>>, choices array<struct<message:struct<content:string>>>")
    joined = lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    anthropic = joined(F.transform(F.filter(blocks["content"], lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]))
    gemini = joined(F.filter(F.flatten(F.transform(blocks["candidates"], lambda c: F.transform(c["content"]["parts"], lambda p: p["text"]))), lambda t: t != ""))
    return F.when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(F.get(blocks["choices"], 0)["message"]["content"])


def normal_answer(text: Column, model: Column, kind: str, ident: Column, created: Column) -> Column:
    """An answer in the chat or responses shape as JSON; null where there is no text."""
    if kind == "chat":
        message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
        out = F.struct(ident.alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"))
    else:
        block = F.struct(F.lit("output_text").alias("type"), text.alias("text"))
        out = F.struct(ident.alias("id"), F.lit("response").alias("object"), created.alias("created"), model.alias("model"), F.array(F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(block).alias("content"))).alias("output"), text.alias("output_text"), F.lit("completed").alias("status"))
    return F.when(text.isNotNull(), F.to_json(out))
