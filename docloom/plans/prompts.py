"""System prompts of the model hooks; callers may pass their own."""

SUMMARY = {
    "text": "Summarise the passage in a few sentences, in its own language, keeping names, numbers and dates that a search would look for.",
    "table": "Describe what the table is about, its columns and units, and the values that stand out, using the background where it helps.",
    "image": "Describe what the picture shows and what it is for, using the background where it helps; read out any labels.",
}
EXTRACTION = {
    "text": "List the facts that the passage states as triples of subject, predicate and object, each with a quote that supports it.",
    "table": "List the facts of the table as triples: first column, column header, cell, with units; leave out empty cells.",
    "image": "List the parts of the diagram and how they are connected as directed triples.",
}
#: Added to an extraction prompt where the kinds of triples are known.
ALLOWED = "Use these kinds of triples where they fit:"
COMMUNITY = "Say in a few sentences what the facts below are about, and which entities matter most."
PATTERN = "Write the question as one pattern of the graph: a JSON object with head, relation and tail, null for what is asked."
GRAPH_ANSWER = "Answer the question from the rows found in the graph and from nothing else."
NOT_KNOWN = "I don't know."


def with_schema(system: str, kinds: list[tuple[str, str, str]]) -> str:
    """An extraction prompt that lists the kinds of triples (head type, relation, tail type) wanted."""
    return "\n".join([system, ALLOWED, *(f"({h})-[{r}]->({t})" for h, r, t in kinds)]) if kinds else system
