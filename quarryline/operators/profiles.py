"""Search profiles: which encoder, which prefixes, where its tables lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    key: str
    model: str
    query_prefix: str = ""
    document_prefix: str = ""


# --- Fixed values -----------------------------------------------------------------------------------
DEFAULT = "minilm"
PROFILES = {
    "minilm": Profile("minilm", "sentence-transformers/all-MiniLM-L6-v2"),
    "e5_base": Profile("e5_base", "intfloat/e5-base-v2", "query: ", "passage: "),
    "minilm_ft": Profile("minilm_ft", "models/retriever/minilm-domain-ft/final"),
    "multilingual": Profile("multilingual", "intfloat/multilingual-e5-small", "query: ", "passage: "),
}
ALIASES = {
    "minilm": ("default", "en", "english", "english_e5", "e5_en", "e5_small_v2", "mini", "minilm_en"),
    "e5_base": ("e5_base_v2", "e5_base_en", "e5base"),
    "minilm_ft": ("minilm_domain_ft", "finetuned", "ft"),
    "multilingual": ("tr", "turkish", "multilingual_e5", "e5"),
}
# --- End of fixed values ----------------------------------------------------------------------------


def names(profile: Profile) -> frozenset[str]:
    """All names a profile goes by."""
    return frozenset((profile.key, *ALIASES.get(profile.key, ())))


def get(key: str | None = None, profiles: dict[str, Profile] = PROFILES) -> Profile:
    """M3: the profile that goes by a name (any case; none: the default one). ValueError where there is none."""
    wanted = key.strip().casefold() if key and key.strip() else DEFAULT
    fitting = [p for p in profiles.values() if wanted in names(p)]
    if len(fitting) != 1:
        raise ValueError(f"{len(fitting)} profiles go by {wanted!r}")
    return fitting[0]


def auxiliary(profile: str) -> str:
    """The second encoder for Turkish queries."""
    return "minilm_ft" if get(profile).key == "multilingual" else "multilingual"


def query_text(text: Column, profile: str | None = None) -> Column:
    """X19."""
    return F.concat(F.lit(get(profile).query_prefix), F.trim(F.coalesce(text, F.lit(""))))


def document_text(text: Column, profile: str | None = None) -> Column:
    """X19."""
    return F.concat(F.lit(get(profile).document_prefix), F.trim(F.coalesce(text, F.lit(""))))


def paths(root: str, profile: str | None = None) -> dict[str, str]:
    """M3: where a profile's tables lie under ``root``: one folder a profile, so a scan prunes to it."""
    base = f"{root.rstrip('/')}/profile={get(profile).key}"
    return {"vectors": f"{base}/vectors", "documents": f"{base}/documents", "index": f"{base}/index"}
