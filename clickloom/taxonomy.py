"""Event vocabulary and property key lists.

Everything in this module is a fixed value: the names decide which events count
for which report, so they have to match what the sites emit. Callers with
another vocabulary pass their own ``Taxonomy``.
"""

from __future__ import annotations

from dataclasses import dataclass

PAGEVIEW = "$pageview"
UNKNOWN = "unknown"

# Event names by class.
FORM_SUBMIT = ("awc_lead_form_submitted", "demo_form_submitted")
MARKETPLACE = (
    "marketplace_details_clicked",
    "marketplace_doc_back",
    "marketplace_doc_link_clicked",
    "marketplace_doc_viewed",
    "marketplace_item_doc_opened",
    "marketplace_preview_clicked",
)
MARKETPLACE_BROWSE = MARKETPLACE + (
    "blueprint_card_clicked",
    "blueprint_evaluated",
    "hero_secondary_clicked",
    "marketplace_view_all_clicked",
)
BLUEPRINT_INTERACTION = (
    "blueprint_card_clicked",
    "blueprint_evaluated",
    "marketplace_details_clicked",
    "marketplace_doc_viewed",
    "marketplace_item_doc_opened",
    "marketplace_preview_clicked",
)
BLUEPRINT_DETAIL = ("marketplace_details_clicked",)
DOC_VIEW = ("marketplace_doc_viewed", "marketplace_item_doc_opened")
CTA = ("awc_lead_form_submit_clicked", "cta_header_clicked", "hero_cta_clicked")
CTA_LEADERBOARD = CTA + ("button_clicked", "hero_secondary_clicked", "nav_link_clicked")
FAQ = ("faq_expanded", "faq_opened")
PLAYGROUND = ("engine_deploy_clicked", "playground_tab_changed")
IDENTIFY = ("user_identified",)

# A navigation click or page that also counts as browsing.
BROWSE_LINK_EVENT = "nav_link_clicked"
BROWSE_PATH = "/features"

# Property keys, in order of preference.
BLUEPRINT_KEYS = ("blueprint", "blueprint_name", "title", "service")
CTA_KEYS = ("label", "button", "target", "name", "href")
FAQ_KEYS = ("question",)
ENGINE_KEYS = ("engine", "engine_title", "tab")
EMAIL_KEYS = ("email", "business_email", "userId")
COMPONENT_KEYS = ("button", "feature", "action", "tab", "label", "target", "href")

# Prefixes dropped from event names in the treemap.
SHORT_NAME_PREFIXES = ("marketplace_", "blueprint_")

# Funnel steps (id, label), in order.
FUNNEL_STEPS = (
    ("pageview", "Visited site ($pageview)"),
    ("marketplace_browse", "Browsed Marketplace"),
    ("blueprint_detail", "Opened Blueprint detail"),
    ("doc_read", "Read Blueprint doc"),
    ("cta_click", "Clicked lead/demo CTA"),
    ("form_submit", "Submitted lead form"),
)

# Time-to-convert buckets (id, label, from second, below second).
CONVERT_BUCKETS = (
    ("under_1m", "Under 1 min", 0, 60),
    ("1_5m", "1–5 min", 60, 300),
    ("5_30m", "5–30 min", 300, 1800),
    ("over_30m", "Over 30 min", 1800, None),
)

# Weekday labels, Monday is 0.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# Latency bucket bounds in seconds.
PUBLISH_LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 45.0)

# Catalog rules, the first lowercase substring found in a name wins.
CATEGORY_RULES = (
    ("kafka", "Streaming"),
    ("csa", "Streaming"),
    ("streaming", "Streaming"),
    ("trino", "Lakehouse"),
    ("lakehouse", "Lakehouse"),
    ("hive", "Lakehouse"),
    ("ozone", "Lakehouse"),
    ("cai", "AI"),
    ("cde", "Data Engineering"),
    ("cdf", "Data Flow"),
    ("cdx", "Analytics"),
    ("dataviz", "Analytics"),
    ("data-engineering", "Data Engineering"),
    ("postgres", "Data Services"),
    ("valkey", "Data Services"),
    ("prometheus", "Observability"),
    ("surveyor", "Observability"),
    ("udf", "Governance"),
    ("secret", "Platform"),
    ("cadence", "Orchestration"),
    ("cwo", "Orchestration"),
    ("yunikorn", "Platform"),
)
CATEGORY_DEFAULT = "Platform"
ICON_RULES = (
    ("kafka", "KM"),
    ("csa", "CSA"),
    ("streaming", "SA"),
    ("trino", "TR"),
    ("lakehouse", "LH"),
    ("hive", "HM"),
    ("ozone", "OZ"),
    ("cai", "AI"),
    ("cde", "DE"),
    ("cdf", "DF"),
    ("cdx", "DX"),
    ("dataviz", "DV"),
    ("postgres", "PG"),
    ("prometheus", "PM"),
    ("surveyor", "SV"),
    ("udf", "UDF"),
    ("cadence", "CW"),
    ("cwo", "WO"),
)


@dataclass(frozen=True)
class Taxonomy:
    """Event-name classes used by the reports; replace any field to re-aim them."""

    pageview: str = PAGEVIEW
    form_submit: tuple[str, ...] = FORM_SUBMIT
    marketplace: tuple[str, ...] = MARKETPLACE
    marketplace_browse: tuple[str, ...] = MARKETPLACE_BROWSE
    blueprint_interaction: tuple[str, ...] = BLUEPRINT_INTERACTION
    blueprint_detail: tuple[str, ...] = BLUEPRINT_DETAIL
    doc_view: tuple[str, ...] = DOC_VIEW
    cta: tuple[str, ...] = CTA
    cta_leaderboard: tuple[str, ...] = CTA_LEADERBOARD
    faq: tuple[str, ...] = FAQ
    playground: tuple[str, ...] = PLAYGROUND
    identify: tuple[str, ...] = IDENTIFY
    browse_link_event: str = BROWSE_LINK_EVENT
    browse_path: str = BROWSE_PATH

    #: class name -> field holding its event names
    CLASSES = (
        "form_submit",
        "marketplace",
        "marketplace_browse",
        "blueprint_interaction",
        "doc_view",
        "cta",
        "cta_leaderboard",
        "faq",
        "playground",
        "identify",
    )


DEFAULT = Taxonomy()
