"""Column expressions: text, labels, prompts, responses, vectors."""
