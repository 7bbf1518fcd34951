"""Learning steps such as ``10m`` or ``1d`` on the driver."""

import re


def step_is_long(step: str) -> bool:
    """Whether a step lasts a day or more, or can't be read."""
    found = re.fullmatch(r"([0-9]+)([mhd])", step.strip().lower())
    return found is None or found[2] == "d" or (found[2] == "h" and int(found[1]) >= 24)


def parse_steps(text: str) -> tuple[str, ...]:
    steps = tuple(s for s in re.split(r"[,\s]+", text.strip().lower()) if s)
    wrong = [s for s in steps if not re.fullmatch(r"[0-9]+[mhd]", s)]
    if wrong or not steps:
        raise ValueError(f"learning steps are numbers with m, h or d: {text!r}")
    return steps
