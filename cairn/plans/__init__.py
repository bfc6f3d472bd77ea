"""Plan building blocks, and the user's verbs on top of the operators."""
