"""Column -> Column functions: address text, capital case, dates, urls, iCalendar text."""
