"""Translations of payloads for providers in plain Python, which the expressions are held against."""

from __future__ import annotations

from typing import Any

from palimpsest.operators.providers import CHAT_FIELDS, RESPONSE_FIELDS


class Unsupported(ValueError):
    """A payload that a provider's translation refuses."""


def _response_messages(given: Any) -> list[tuple[str, str]]:
    """(role, text) of a response payload's input."""
    if isinstance(given, str):
        return [("user", given)]
    if not isinstance(given, list) or not given or not all(isinstance(m, dict) for m in given):
        raise Unsupported("responses_input")
    out = []
    for m in given:
        blocks = m.get("content")
        role = m.get("role", "user")
        if set(m) - {"role", "content"} or not isinstance(role, str) or not isinstance(blocks, list) or not blocks:
            raise Unsupported("responses_input")
        if role not in ("system", "user", "assistant"):
            raise Unsupported("responses_roles")
        for b in blocks:
            if not isinstance(b, dict) or set(b) - {"type", "text"} or not isinstance(b.get("text", ""), str):
                raise Unsupported("responses_input")
            if b.get("type") != "input_text":
                raise Unsupported("responses_multimodal")
            if "text" not in b:
                raise Unsupported("responses_input")
        out.append((role, "\n".join(b["text"] for b in blocks)))
    return out


def _messages(payload: dict, kind: str, provider: str) -> list[tuple[str, str]]:
    chat = kind == "chat"
    if set(payload) - (CHAT_FIELDS.get(provider, set()) if chat else RESPONSE_FIELDS):
        raise Unsupported("field")
    refused = ("tools", "tool_choice", "response_format", "logit_bias", "stop") if chat else ("tools", "tool_choice", "parallel_tool_calls", "store", "metadata")
    if any(payload.get(f) is not None for f in refused) or any(payload.get(f) for f in ("previous_response_id", "instructions", "user") if not chat):
        raise Unsupported("field")
    if not chat:
        return _response_messages(payload.get("input"))
    out = []
    for m in payload.get("messages") or []:
        if set(m) - {"role", "content"}:
            raise Unsupported("message field")
        if m.get("role") not in ("system", "user", "assistant"):
            raise Unsupported("roles")
        out.append((m["role"], m.get("content") or ""))
    return out


def _given(payload: dict, names: dict[str, str]) -> dict:
    return {new: payload[old] for old, new in names.items() if payload.get(old) is not None}


def translate(payload: dict, kind: str, provider: str) -> dict:
    """The provider's request for a chat or responses payload; OpenAI's is the payload itself, as is DeepSeek's for chats."""
    if provider == "openai" or (provider == "deepseek" and kind == "chat"):
        return payload
    if provider == "deepseek" and payload.get("stream"):
        raise Unsupported("responses_streaming")
    messages = _messages(payload, kind, provider)
    limit = "max_tokens" if kind == "chat" else "max_output_tokens"
    system = [t for r, t in messages if r == "system" and t]
    if provider == "anthropic":
        out = {"model": payload.get("model", ""), "messages": [{"role": r, "content": [{"type": "text", "text": t}]} for r, t in messages if r != "system"], "max_tokens": 1024}
        if system:
            out["system"] = "\n".join(system)
        return out | _given(payload, {limit: "max_tokens", "temperature": "temperature", "top_p": "top_p"})
    if provider == "gemini":
        out = {"contents": [{"role": "model" if r == "assistant" else "user", "parts": [{"text": t}]} for r, t in messages if r != "system"]}
        if system:
            out["systemInstruction"] = {"parts": [{"text": t} for t in system]}
        settings = _given(payload, {limit: "maxOutputTokens", "temperature": "temperature", "top_p": "topP"})
        return out | ({"generationConfig": settings} if settings else {})
    out = {"model": payload.get("model", ""), "messages": [{"role": r, "content": t} for r, t in messages]}
    return out | _given(payload, {limit: "max_tokens", "temperature": "temperature", "top_p": "top_p"})
