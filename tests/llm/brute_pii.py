"""The base contract of the personal-data query, plainly in Python."""

import hashlib
import re

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


#: Texts that the patterns can trip over.
BASE_TEXTS = [
    "a@b.c_d@e.f.g x", "a@b.c._x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+" + "1" * 500, "4111 1111 1111 1111 9", "4111-1111-1111-1111",
    "a" * 500 + "@" + "b.c" * 300, "é+49 (0)30 1234567 x", "GB82 WEST 1234 5698 7654 32 ssn 123-45-6789", "@@a@b.c", "Mail: x@y.zz, +1 (212) 555-0100.", "1 " * 500,
]
