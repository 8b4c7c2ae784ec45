"""Questions in words: what they name, the plan they ask for, and follow-ups to them."""
