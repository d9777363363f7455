"""The registered queries, by area, each with its SQL where SQL can say it."""
