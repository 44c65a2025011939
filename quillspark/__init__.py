"""Analytics over document records: storage, text, dates, matching, geometry, review, labelling."""
