"""Rule lists of the contact operators, in a frozen set that plans take as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rules:
    # Results depend on these words and their order.
    preferred_mailboxes: tuple[str, ...] = ("info@", "contact@", "hello@", "support@", "sales@", "admin@")
    public_providers: tuple[str, ...] = (
        "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "proton.me", "protonmail.com",
        "yandex.com", "gmx.com", "mail.com", "sbcglobal.net", "att.net", "bellsouth.net", "verizon.net", "comcast.net",
    )
    block_substrings: tuple[str, ...] = (
        ".png", ".jpg", ".jpeg", ".gif", ".webp", "wixpress.com", "sentry.io", "noreply", "no-reply", "abuse", "subscribe",
        "mailer-daemon", "example.com", "domain.com", "email.com", "yourname", "wix.com", ".js", ".css", ".html", ".php", ".asp", "browser-agent.",
        "test@", "example@", "noreply@", "no-reply@", "privacy@",
    )
    allowed_suffixes: tuple[str, ...] = (".com", ".net", ".org", ".edu", ".gov", ".us")
    second_level: tuple[str, ...] = ("co", "com", "org", "net", "gov", "edu", "ac")
    blocked_domains: tuple[str, ...] = (
        "cloudflareinsights.com", "mysite.com", "example.com", "domain.com", "email.com", "localhost", "invalid", "h.com", "ic.com", "wp.com", "linkedin.com",
    )
    generic_locals: tuple[str, ...] = ("info", "contact", "hello", "support", "sales", "admin", "office", "mail", "email", "team", "usa")
    contact_priority: tuple[tuple[str, int], ...] = (
        ("contact-us", 0), ("contactus", 0), ("contact-me", 0), ("contact", 0), ("get-in-touch", 0), ("consultation", 0), ("request-quote", 0),
        ("estimate", 0), ("free-estimate", 0), ("appointment", 1), ("book", 1), ("schedule", 1), ("about-us", 2), ("about-me", 2), ("about", 2),
        ("team", 2), ("our-team", 2), ("meet-the-team", 2), ("support", 2), ("customer-service", 2), ("privacy-policy", 3), ("privacy", 3),
        ("legal", 3), ("services", 4), ("info", 4),
    )
    target_paths: tuple[str, ...] = (
        "/contact", "/contact-us", "/contact-me", "/about", "/about-us", "/about-me", "/team", "/our-team", "/meet-the-team",
        "/support", "/customer-service", "/help", "/feedback", "/sales", "privacy", "return", "location", "policy", "faq",
        "/estimate", "/free-estimate", "/request-quote", "/consultation", "/appointment", "/schedule", "/get-in-touch", "/book",
        "/company", "/who-we-are", "/staff", "/locations", "/impressum", "/legal", "/privacy-policy", "/info", "/information",
        "/services", "/quote", "/imprint",
    )
    min_root_letters: int = 2
    allow_subdomains: bool = False


STRICT = Rules()
#: Without the example-domain entries and the subdomain rule, so that sample data has something to rank.
LENIENT = replace(
    STRICT,
    block_substrings=tuple(x for x in STRICT.block_substrings if x != "example.com"),
    blocked_domains=tuple(x for x in STRICT.blocked_domains if x != "example.com"),
    allow_subdomains=True,
)

#: policy: (public providers allowed, other domains allowed)
POLICIES = {"business_only": (False, False), "business_or_public": (True, False), "any_valid": (True, True)}
