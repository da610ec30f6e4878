"""Regular expressions whose classes and case folding cover Unicode, or classes of ASCII."""


def rx(pattern: str, any_case: bool = False) -> str:
    """The pattern with Unicode classes, and with Unicode case folding if any_case."""
    return ("(?iuU)" if any_case else "(?U)") + pattern


def re2(pattern: str, any_case: bool = False) -> str:
    """The pattern with white space, word borders and ends of text as RE2 has them, which SQL engines use: those of ASCII."""
    border = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return ("(?iu)" if any_case else "") + pattern.replace(r"\s", r"[\t\n\f\r ]").replace(r"\b", border).replace("$", r"\z")
