"""DataFrame operators: contacts, messages, tokens, summaries, quality, insights."""
