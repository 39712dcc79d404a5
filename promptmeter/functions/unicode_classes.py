"""Character classes of the pre-tokenizers, as ranges of code points."""

from __future__ import annotations

# The simplified classes that decide how texts split.
LOWER = [(0x61, 0x7A), (0xE0, 0xF6), (0xF8, 0xFF), (0x3B1, 0x3C9), (0x430, 0x44F)]
UPPER = [(0x41, 0x5A), (0xC0, 0xD6), (0xD8, 0xDE), (0x391, 0x3A9), (0x410, 0x42F)]
TITLE = [0x1C5, 0x1C8, 0x1CB, 0x1F2, (0x1F88, 0x1F8F), (0x1F98, 0x1F9F), (0x1FA8, 0x1FAF), 0x1FBC, 0x1FCC, 0x1FFC]
MODIFIER = [
    (0x2B0, 0x2C1), (0x2C6, 0x2D1), (0x2E0, 0x2E4), 0x2EC, 0x2EE, 0x374, 0x37A, 0x559, 0x640, 0x6E5, 0x6E6, 0x7F4, 0x7F5, 0x7FA,
    0x81A, 0x824, 0x828, 0x971, 0xE46, 0xEC6, 0x10FC, 0x17D7, 0x1843, 0x1AA7, (0x1C78, 0x1C7D), (0x1D2C, 0x1D6A), 0x1D78,
    (0x1D9B, 0x1DBF), 0x2071, 0x207F, (0x2090, 0x209C), 0x2C7C, 0x2C7D, 0x2D6F, 0x2E2F, 0x3005, (0x3031, 0x3035), 0x303B,
    0x309D, 0x309E, (0x30FC, 0x30FE), 0xA015, (0xA4F8, 0xA4FD), 0xA60C, 0xA67F, (0xA717, 0xA71F), 0xA770, 0xA788, 0xA7F8,
    0xA7F9, 0xA9CF, 0xA9E6, 0xAA70, 0xAADD, 0xAAF3, 0xAAF4, (0xAB5C, 0xAB5F), 0xFF70, 0xFF9E, 0xFF9F,
]
OTHER = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7AF), (0x621, 0x64A), (0x5D0, 0x5EA), (0xE01, 0xE3A), (0x905, 0x939)]
MARK = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
NUMBER = [(0x30, 0x39), 0xB2, 0xB3, 0xB9, (0x2070, 0x2079), (0x2080, 0x2089), (0xFF10, 0xFF19), (0x2160, 0x2188), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F), (0x9E6, 0x9EF), 0x3007, (0x3021, 0x3029)]
SPACE = [0x20, 0x9, 0xA, 0xD, 0xB, 0xC, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF)]

LETTER = LOWER + UPPER + TITLE + MODIFIER + OTHER


def _point(cp: int, java: bool) -> str:
    return f"\\x{{{cp:X}}}" if java else f"\\U{cp:08x}"


def in_class(ranges, java: bool = True) -> str:
    """The inside of a regex character class, for Java (Spark SQL) or Python."""
    return "".join(_point(r, java) if isinstance(r, int) else f"{_point(r[0], java)}-{_point(r[1], java)}" for r in ranges)
