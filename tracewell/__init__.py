"""Analytics over incident reports and knowledge-base graphs, as DataFrame to DataFrame operators."""
