"""Report providers that call out: one request a report, by the model that the settings name."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from ..config import Settings

Provider = Callable[[str, str, str], str]
#: The model that needs no provider: reports are filled from a template.
TEMPLATE = "template"


def http_provider(settings: Settings) -> Provider:
    """Posts ``{"model", "system", "message"}`` as JSON to ``llm_url``, with the key as a bearer token, and takes ``text`` of the answer.

    Whatever goes wrong, an answer without a text included, is raised, and becomes the error of that report's row.
    """
    url, model, key, timeout = settings.llm_url, settings.llm_model, settings.llm_api_key, settings.llm_timeout_seconds

    def ask(system: str, message: str, evidence: str) -> str:
        body = json.dumps({"model": model, "system": system, "message": message}, ensure_ascii=False).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json; charset=utf-8", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            text = json.loads(response.read().decode("utf-8")).get("text")
        if not isinstance(text, str):
            raise RuntimeError("the provider returned no text")
        return text

    return ask


def provider_of(settings: Settings, template: Provider) -> Provider:
    """The provider for ``llm_model``: the template, or the one at ``llm_url``, which must be set."""
    if settings.llm_model == TEMPLATE:
        return template
    if not settings.llm_url:
        raise ValueError(f"the model {settings.llm_model!r} needs the address of its provider: set LLM_URL")
    return http_provider(settings)
