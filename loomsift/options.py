"""Options of a run."""

from dataclasses import dataclass, field

from loomsift.functions import vocab


@dataclass(frozen=True)
class GateOptions:
    """Thresholds and lists of the content gates."""

    min_chars: int = 150
    max_chars: int | None = None  # of text kept, not of text tested
    text_limit: int | None = None  # of extracted text
    short_min_chars: int = 100
    allow_short_quality: bool = False
    ignore_quality_short: bool = False
    use_quality_filter: bool = True
    quality_threshold: float = 50.0
    digit_density: bool = True
    keywords_in: tuple[str, ...] = ()
    keywords_out: tuple[str, ...] = ()
    domain_blacklist: tuple[str, ...] = ()
    clean_code: bool = False


# The looser settings of an interactive run.
INTERACTIVE_GATES = GateOptions(allow_short_quality=True, short_min_chars=50, quality_threshold=35.0)


@dataclass(frozen=True)
class CrawlOptions:
    """Limits of the frontier."""

    max_depth: int = 3
    links_per_page: int = 20
    max_per_domain: int = 100
    same_domain: bool = True
    prioritize_content: bool = True
    crawler_enabled: bool = True
    stop_after: int = 0  # accepted pages, 0 for no limit
    order_seed: str = ""


@dataclass(frozen=True)
class RenderOptions:
    """Chat template and prompts of the rendered rows."""

    template: str = vocab.DEFAULT_TEMPLATE
    content_type: str = vocab.DEFAULT_CONTENT_TYPE
    system_prompt: str = vocab.DEFAULT_SYSTEM
    custom_prompt: str = ""


@dataclass(frozen=True)
class CodeOptions:
    """Size limits of source files; without ``max_size`` all are read."""

    max_size: int | None = None
    min_chars: int = 50
    render: RenderOptions = field(default_factory=lambda: RenderOptions(content_type=vocab.CODE_CONTENT_TYPE))


def word_list(text: str) -> tuple[str, ...]:
    """Comma-separated words, stripped and lower-cased."""
    return tuple(w.strip().lower() for w in text.split(",") if w.strip())
