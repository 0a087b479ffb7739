"""Sources: source trees (``code``), language-server caches (``lspcache``), session logs (``sessions``) and their tails (``tail``)."""
