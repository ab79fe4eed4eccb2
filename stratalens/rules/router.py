"""Keyword tables that route a question."""

from .pack import Rule

# Fixed values throughout this file: labels and keywords in order of precedence.

INTENTS = (
    Rule("partnership_strategy", ("collab", "collaboration", "collaborate", "partner", "partnership", "joint venture", "alliance", "work with", "team up")),
    Rule("risk_analysis", ("risk", "threat", "danger", "weakness", "problem", "delay", "uncertainty", "what could go wrong", "concern")),
    Rule("opportunity_analysis", ("opportunity", "growth", "expand", "investment", "invest", "market", "new business", "advantage")),
    Rule("recommendation_drilldown", ("explain recommendation", "why recommend", "recommendation", "support this", "evidence for", "why should")),
    Rule("scenario_analysis", ("what if", "scenario", "suppose", "if fcas", "if budget", "if dassault", "if delayed", "under condition")),
    Rule("competitor_analysis", ("competitor", "dassault", "boeing", "lockheed", "bae", "leonardo", "saab", "thales", "rheinmetall")),
    Rule("evidence_request", ("evidence", "sources", "proof", "show me", "where did", "cite", "supporting documents")),
)
DEFAULT_INTENT = "general_strategy"
RISK_INTENTS = ("risk_analysis", "scenario_analysis", "partnership_strategy", "recommendation_drilldown", "general_strategy")

TOPICS = (
    Rule("FCAS", ("fcas", "future combat air system", "sixth-generation", "sixth generation", "future fighter", "fighter jet")),
    Rule("Eurofighter", ("eurofighter", "typhoon")),
    Rule("Uncrewed Combat Aircraft", ("uncrewed", "unmanned", "uav", "uas", "drone", "eurodrone", "sirtap", "collaborative combat aircraft", "loyal wingman")),
    Rule("Military Space", ("space", "satellite", "secure communications", "earth observation", "military satellite")),
    Rule("Aerial Refuelling", ("a330 mrtt", "mrtt", "tanker", "refuelling", "refueling")),
    Rule("Military Transport", ("a400m", "c295", "cn235", "transport aircraft")),
    Rule("Supply Chain", ("supply chain", "supplier", "delivery", "shortage", "production", "manufacturing")),
    Rule("European Defence Autonomy", ("european defence", "european defense", "sovereign", "sovereignty", "strategic autonomy", "nato", "europe")),
    Rule("Policy and Procurement", ("procurement", "contract", "ministry", "government", "budget", "export", "regulation", "policy")),
)
AREAS = (
    Rule("Airbus Defence and Space", ("defence", "defense", "fighter", "military", "space", "satellite", "fcas", "eurofighter", "a400m", "mrtt", "drone", "sirtap")),
    Rule("Airbus Commercial Aircraft", ("commercial", "airline", "a320", "a350", "a330neo", "passenger", "aircraft delivery")),
    Rule("Airbus Helicopters", ("helicopter", "h145", "h160", "rotorcraft")),
    Rule("Airbus Corporate / Group Strategy", ("airbus as a company", "group", "corporate", "overall", "company")),
)
REGIONS = (
    Rule("Europe", ("europe", "european", "eu", "nato")),
    Rule("Germany", ("germany", "german", "bundeswehr")),
    Rule("France", ("france", "french")),
    Rule("Spain", ("spain", "spanish")),
    Rule("United Kingdom", ("uk", "britain", "british", "united kingdom")),
    Rule("Italy", ("italy", "italian")),
    Rule("United States", ("united states", "usa", "us ", "american")),
)
CONSTRAINTS = (
    Rule("low_budget", ("low budget", "limited budget", "cheap", "cost effective", "lower cost")),
    Rule("low_risk", ("low risk", "safe", "conservative", "less risky")),
    Rule("urgent", ("urgent", "quick", "immediate", "short term", "near term", "now")),
    Rule("long_term", ("long term", "future", "2030", "2035", "sixth-generation")),
    Rule("partnership_required", ("with partner", "collaborate", "collaboration", "partner")),
)
PARTNER_TERMS = ("partner", "collab", "collaboration", "alliance", "country", "organisation", "organization")
