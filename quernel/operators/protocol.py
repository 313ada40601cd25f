"""Generation settings and the arguments of evaluation runs."""

from __future__ import annotations

from pathlib import PurePosixPath

# The standard decoder and what each diagnostic variant changes in it.
STANDARD = {
    "do_sample": False,
    "temperature": 0.75,
    "top_p": 0.90,
    "top_k": 0,
    "repetition_penalty": 1.0,
    "no_repeat_ngram_size": 0,
    "max_new_tokens": 96,
    "num_beams": 1,
    "num_return_sequences": 1,
    "use_cache": True,
}
VARIANTS = {"none": {}, "length256": {"max_new_tokens": 256}, "greedy": {"do_sample": False}, "no_penalty": {"repetition_penalty": 1.0}, "no_ngram": {"no_repeat_ngram_size": 0}}


def settings(variant: str = "none") -> dict:
    """A copy of the standard settings with one variant's change; three variants change nothing, as the standard already has their values."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    return STANDARD | VARIANTS[variant]


def check_arguments(split: str, limit: int, variant: str = "none", name: str | None = None) -> None:
    """Variants run on 20 or 200 rows of the validation split only; limits are not negative; a run's name is one path part."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if variant != "none" and (split != "val" or limit not in (20, 200)):
        raise ValueError("variants run on the validation split with limit 20 or 200")
    if name is not None and (name in ("", ".", "..") or PurePosixPath(name).name != name):
        raise ValueError("the run's name must be one path part")
