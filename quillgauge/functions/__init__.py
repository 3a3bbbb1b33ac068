"""Column expressions over text, responses, prompts and hash keys."""
