"""Options of the engine, as words of a command line or as a dictionary.

Fixed values: the options' names, kinds and defaults.  A flag is off unless it
is named; stages are counted from 1.
"""

from __future__ import annotations

import json

FLAG = bool
#: name -> kind or choices, default
OPTIONS: dict[str, tuple[object, object]] = {
    "help": (FLAG, False),
    "verbose": (FLAG, False),
    "layout": (("0", "1", "1.5", "2"), "0"),
    "layout-direction": (("lr", "rl"), "lr"),
    "orientation": (("left", "right", "upsidedown", "none"), "none"),
    "rotate": (float, 0.0),
    "deskew": (("auto", "manual"), "auto"),
    "skew-deviation": (float, 5.0),
    "disable-content-detection": (FLAG, False),
    "enable-page-detection": (FLAG, False),
    "enable-fine-tuning": (FLAG, False),
    "force-disable-page-detection": (FLAG, False),
    "content-detection": (("cautious", "normal", "aggressive"), "normal"),
    "content-box": ("box", None),
    "content-deviation": (float, 1.0),
    "enable-auto-margins": (FLAG, False),
    **{f"{p}margins{s}": (float, None if s else 0.0) for p in ("", "default-") for s in ("", "-left", "-right", "-top", "-bottom")},
    "match-layout": (("true", "false"), "true"),
    "match-layout-tolerance": (float, None),
    "match-layout-default": (("true", "false"), "true"),
    "alignment": (("original", "auto", "center"), "center"),
    "alignment-vertical": (("top", "center", "bottom", "original", "auto"), "center"),
    "alignment-horizontal": (("left", "center", "right", "original", "auto"), "center"),
    "alignment-tolerance": (float, 0.2),
    **{f"{p}dpi{s}": (int, None if s else 600 if p else 300) for p in ("", "output-") for s in ("", "-x", "-y")},
    "color-mode": (("black_and_white", "color_grayscale", "mixed"), "black_and_white"),
    "white-margins": (FLAG, False),
    "normalize-illumination": (FLAG, False),
    "threshold": (int, 0),
    "despeckle": (("off", "cautious", "normal", "aggressive"), "normal"),
    "dewarping": (("off", "auto"), "off"),
    "depth-perception": (float, 2.0),
    "start-filter": (int, 1),
    "end-filter": (int, 6),
    "output-project": (str, None),
    "tiff-compression": (("none", "packbits", "deflate"), "packbits"),
    "picture-shape": (("free", "rectangular"), "free"),
    "language": (str, "en"),
    "disable-content-text-mask": (FLAG, False),
    "window-title": (str, None),
    "page-detection-box": ("size", None),
    "page-detection-tolerance": (float, 0.1),
    **{f"page-borders{s}": (float, None if s else 0.0) for s in ("", "-left", "-right", "-top", "-bottom")},
    "disable-check-output": (FLAG, False),
    "default-output-dpi": (int, 600),
    "default-color-mode": (("black_and_white", "color_grayscale", "mixed"), "black_and_white"),
    "tiff-force-rgb": (FLAG, False),
    "tiff-force-grayscale": (FLAG, False),
    "tiff-force-keep-color-space": (FLAG, False),
    "print-stats": (FLAG, False),
}
SHORT = {"h": "help", "v": "verbose", "l": "layout", "ld": "layout-direction", "o": "output-project"}


def _value(name: str, text: str) -> object:
    kind, _ = OPTIONS[name]
    if kind is FLAG:
        if text not in ("true", "false"):
            raise ValueError(f"{name}: {text}")
        return text == "true"
    if isinstance(kind, tuple):
        if text not in kind:
            raise ValueError(f"{name}: {text} is none of {', '.join(kind)}")
        return text
    if kind == "box":
        left, rest = text.split("x", 1)
        top, size = rest.split(":", 1)
        width, height = size.split("x", 1)
        return tuple(float(v) for v in (left, top, width, height))
    if kind == "size":
        return tuple(float(v) for v in text.split("x", 1))
    try:
        return kind(text)
    except ValueError as e:
        raise ValueError(f"{name}: {text}") from e


def parsed(words: list[str]) -> tuple[dict[str, object], list[str]]:
    """All options with their values, and the words that aren't options (inputs and the output folder)."""
    given: dict[str, object] = {}
    rest = []
    for w in words:
        if not w.startswith("-") or w == "-":
            rest.append(w)
            continue
        name, equal, text = w.lstrip("-").partition("=")
        name = SHORT.get(name, name) if not w.startswith("--") else name
        if name not in OPTIONS:
            raise ValueError(f"no option {name}")
        if not equal and OPTIONS[name][0] is not FLAG:
            raise ValueError(f"{name} needs a value")
        given[name] = _value(name, text) if equal else True
    out = {k: given.get(k, d) for k, (_, d) in OPTIONS.items()}
    for group in ("margins", "default-margins", "page-borders", "dpi", "output-dpi"):  # a side's own value, or the group's
        for k in out:
            if k.startswith(group + "-") and out[k] is None:
                out[k] = out[group]
    if not 1 <= out["start-filter"] <= out["end-filter"] <= 6:
        raise ValueError("start-filter and end-filter: 1 to 6 in this order")
    return out, rest


def fingerprint(options: dict[str, object]) -> str:
    """The options as text, for tables of results that may be used again."""
    return json.dumps(options, sort_keys=True)
