"""The registered queries and their SQL oracles, over the V_* views."""
