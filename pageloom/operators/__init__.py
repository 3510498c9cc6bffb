"""DataFrame operators: cleaning, links, chunks, requests, cost, batches."""
